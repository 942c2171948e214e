"""URL filters: rules of domains first, then a tree of path templates for each host, judged by smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.members import own, unused
from tidemark.tables import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: File endings that a wildcard keeps.
ENDINGS = r"\.(?:html?|php|aspx?|jsp|cgi|pdf|xml|json|txt|jpe?g|png|gif)$"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host with all its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Templates:
    """Parameters. A segment stands as it is where ``least`` distinct paths and ``share`` of its parent's hold it, else it becomes a
    wildcard; segments from number ``depth`` on are one wildcard. Sibling branches merge while a test of their
    two proportions stays below ``alike`` (chi-squared, one degree of freedom). Each node's share of bad labels is smoothed by
    ``prior`` labels at its parent's share; templates from ``reject`` on are blocked."""

    least: int = 5
    share: float = 0.05
    depth: int = 8
    alike: float = 3.84
    prior: float = 10.0
    reject: float = 0.5


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def ruled(pages: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """``pages`` with ``rule`` and ``action`` of the longest rule that fits (of equally long ones that of the longer host; null if none does).

    Hosts meet rules by an equi join of their suffixes, and bring each host's list of rules, longest first, to its pages: a list is as long as the rules
    of its domains, and nothing is compared with rules of other hosts.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.action, r.host, r.path, r.name) for r in rules], "action string, fits string, starts string, rule string")
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select(host).distinct().withColumn("fits", F.explode(suffixes)).join(table, "fits")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("fits")).alias("b"), F.col("rule").alias("rule"), F.col("action").alias("action"), F.col("starts").alias("starts"))
    lists = hosts.groupBy(host).agg(F.array_sort(F.collect_list(order)).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col(path), r["starts"])), F.lit(0))
    return pages.join(lists, host, "left").withColumns({"rule": first["rule"], "action": first["action"]}).drop("rules")


def _wild(seg: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(seg, ENDINGS, 0))


def templates(paths: DataFrame, conf: Templates = Templates()) -> DataFrame:
    """``paths`` (distinct ``host, path`` and any others) with ``tokens``, the template of each path.

    One round for each level of the deepest path: children are counted below what has become of their parents, so that what
    follows a wildcard is counted over all that it stands for. A child that falls short of ``least`` is out before its parent is met.
    """
    segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    held = materialise(paths.withColumns({"segs": F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segs), "tokens": F.array().cast("array<string>")}))
    deepest = held.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(min(deepest, conf.depth)):
        seg = F.get("segs", F.lit(level))
        deep = held.where(F.size("segs") > level).select("host", "tokens", seg.alias("seg"))
        stats = materialise(deep.groupBy("host", "tokens", "seg").agg(F.count(F.lit(1)).alias("n")))
        parents = stats.groupBy("host", "tokens").agg(F.sum("n").alias("of"))
        kept = stats.where(F.col("n") >= conf.least).join(parents, ["host", "tokens"]).where(F.col("n") >= F.col("of") * conf.share)
        kept = kept.select("host", "tokens", "seg", F.lit(True).alias("kept"))
        token = F.when(F.col("kept"), F.col("seg")).otherwise(_wild(F.col("seg")))
        held = held.withColumn("seg", seg).join(kept, ["host", "tokens", "seg"], "left")
        held = materialise(held.withColumn("tokens", F.when(F.col("seg").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(token)))).drop("seg", "kept"))
    deeper = F.size("segs") > conf.depth
    return held.withColumn("tokens", F.when(deeper, F.concat("tokens", F.array(F.lit("**")))).otherwise(F.col("tokens"))).drop("segs")


def _merged(children: Column, conf: Templates) -> Column:
    """Groups of ``children`` (token, bad, seen; ordered by their shares): each joins the group before while their shares are alike; without labels it stands alone."""

    def similar(a: Column, b: Column) -> Column:
        both, n = a["bad"] + b["bad"], a["seen"] + b["seen"]
        mean = both / n
        gap = a["bad"] / a["seen"] - b["bad"] / b["seen"]
        spread = mean * (1 - mean) * (1 / a["seen"] + 1 / b["seen"])
        return (a["seen"] > 0) & (b["seen"] > 0) & F.when((a["seen"] > 0) & (b["seen"] > 0), (spread == 0) | (gap * gap < conf.alike * spread)).otherwise(False)

    single = lambda c: F.struct(F.array(c["token"]).alias("members"), c["bad"].alias("bad"), c["seen"].alias("seen"))

    def add(groups: Column, child: Column) -> Column:
        last = F.element_at(groups, -1)
        joined = F.struct(F.concat(last["members"], F.array(child["token"])).alias("members"), (last["bad"] + child["bad"]).alias("bad"), (last["seen"] + child["seen"]).alias("seen"))
        fits = (F.size(groups) > 0) & F.when(F.size(groups) > 0, similar(last, child)).otherwise(False)
        return F.when(fits, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(single(child))))

    return F.aggregate(children, F.array().cast("array<struct<members:array<string>,bad:double,seen:double>>"), add)


def purities(leaves: DataFrame, conf: Templates = Templates()) -> DataFrame:
    """``host, tokens, purity, template`` of each template in ``leaves`` (``host, tokens, bad, seen``).

    A host starts from its own share of bad labels, smoothed by that of all. Level by level the children of each node
    that are alike become one branch, whose share is smoothed by that of the branch above; ``template`` names the merged branches. A node has ``1 / share`` children
    that stand as they are at most, and a wildcard for each of a fixed list of endings: so the list that is folded is bounded.
    """
    leaves = materialise(leaves.groupBy("host", "tokens").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")))
    smooth = lambda bad, seen, above: (bad + above * conf.prior) / (seen + conf.prior)
    everywhere = leaves.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("seen"), F.lit(0.0)), F.lit(0.0)).alias("p")).first()["p"]
    hosts = leaves.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    above = hosts.select("host", F.array().cast("array<string>").alias("tokens"), smooth(F.col("bad"), F.col("seen"), F.lit(everywhere)).alias("purity"), F.lit("").alias("template"))
    nodes = [above]
    deepest = leaves.agg(F.max(F.size("tokens"))).first()[0] or 0
    share = lambda c: (c["bad"] + 0.5) / (c["seen"] + 1)
    for level in range(1, deepest + 1):
        at = leaves.where(F.size("tokens") >= level).select("host", F.slice("tokens", 1, level).alias("tokens"), "bad", "seen")
        at = at.groupBy("host", "tokens").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
        child = F.struct(F.element_at("tokens", -1).alias("token"), "bad", "seen")
        child = F.struct(share(child).alias("order"), child["token"].alias("token"), child["bad"].alias("bad"), child["seen"].alias("seen"))
        grouped = at.groupBy("host", F.slice("tokens", 1, level - 1).alias("tokens")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        grouped = grouped.join(above, ["host", "tokens"]).withColumn("branch", F.explode(_merged(F.col("children"), conf)))
        name = F.concat("template", F.lit("/"), F.array_join(F.array_sort("branch.members"), "|"))
        below = grouped.select("host", "tokens", smooth(F.col("branch.bad"), F.col("branch.seen"), F.col("purity")).alias("purity"), name.alias("template"), F.explode("branch.members").alias("token"))
        above = materialise(below.select("host", F.concat("tokens", F.array("token")).alias("tokens"), "purity", "template"))
        nodes.append(above)
    return leaves.select("host", "tokens").join(reduce(DataFrame.unionByName, nodes), ["host", "tokens"])


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule], conf: Templates = Templates(), url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, template, purity, verdict`` (each with an underscore before it where a column has that name).

    ``labelled`` has ``url`` and ``bad`` (boolean; null counts as no label). The longest fitting rule decides; else a page is blocked where the
    purity of its template is ``reject`` or more. A null url, or one without ``://``, is a page of the empty host. Repeated rows of
    ``pages`` fare alike and count once for templates, repeated labels count each. Without labels nothing but rules blocks. An empty table gives an empty one.
    """
    names = unused(pages, "host", "path", "rule", "template", "purity", "verdict")
    mine = unused(pages, "h_", "p_")
    read = pages.withColumns({mine[0]: host_of(F.col(url_col)), mine[1]: path_of(F.col(url_col))})
    paths = read.select(F.col(mine[0]).alias("host"), F.col(mine[1]).alias("path")).distinct()
    labels = labelled.where("bad is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("double").alias("bad"))
    labels = labels.groupBy("host", "path").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).cast("double").alias("seen"))
    placed = templates(paths.join(labels, ["host", "path"], "left").fillna(0.0, ["bad", "seen"]), conf)
    judged = placed.join(purities(placed.select("host", "tokens", "bad", "seen"), conf), ["host", "tokens"])
    judged = materialise(ruled(judged, rules).select("host", "path", "rule", "action", "template", "purity"))
    method = F.when(F.col("purity") >= conf.reject, "block").otherwise("allow")
    judged = judged.withColumn("verdict", F.coalesce("action", method))
    facts = judged.select(F.col("host").alias(mine[0]), F.col("path").alias(mine[1]), *(F.col(c).alias(n) for c, n in zip(("rule", "template", "purity", "verdict"), names[2:], strict=True)))
    out = read.join(facts, mine)
    return out.select(*own(pages), F.col(mine[0]).alias(names[0]), F.col(mine[1]).alias(names[1]), *names[2:])
