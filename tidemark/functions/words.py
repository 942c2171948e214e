"""Default dictionaries. Every function takes its own in place of these."""

from __future__ import annotations

# Vocabulary and weights that decide results.
PLACEHOLDER_NAMES = ("unknown", "n/a", "none", "-")
NOT_A_NAME = ("stealth startup", "stealth mode", "stealth", "confidential", "new venture", "stealth company", "linkedin member", "linkedin user", "private profile")
LABEL_WORDS = ("stealth", "startup", "start up", "start-up")
SENIOR = ("vp ", "vice president", " cto", " ceo", " coo", " cfo", " cpo", "head of", "director", "general manager", "business head", "country head", "partner", "svp", "evp")
SENIOR_SNIPPET = ("vp", "vice president", "director", "head of", "cxo", "cto", "ceo", "coo")
PEDIGREE = ("razorpay", "grab", "gojek", "sea group", "shopee", "tokopedia", "swiggy", "zomato", "phonepe", "zepto", "cred", "google", "amazon")
SIGNAL_WEIGHTS = (
    ("stealth_headline_change", 24), ("seniority_corroborated", 12), ("profile_verified", 14), ("accelerator_batch", 16),
    ("exec_departure", 18), ("executive_departure", 18), ("company_registration", 15), ("stealth_founder", 15),
    ("second_time_founder", 20), ("funding_announcement", 12), ("funding_news", 12), ("product_launch", 10),
    ("twitter_announce", 10), ("linkedin_headline", 8), ("github_signal", 7), ("headcount_change", 7),
    ("news_mention", 5), ("registry", 13), ("mca_registration", 15), ("acra_registration", 15),
)
SECTORS = (
    ("fintech", ("fintech", "payment", "lending", "credit", "insurance", "neobank", "defi", "crypto")),
    ("saas", ("saas", "software", "b2b", "enterprise", "api", "platform", "data", "analytics")),
    ("consumer", ("consumer", "d2c", "ecommerce", "marketplace", "brand", "retail")),
    ("healthtech", ("health", "medtech", "pharma", "hospital", "doctor", "clinic", "diagnostic", "wellness")),
    ("edtech", ("edtech", "education", "learning", "school", "university", "skills")),
)
REGIONS = (
    ("Singapore", ("singapore",)),
    ("Indonesia", ("indonesia", "jakarta")),
    ("Vietnam", ("vietnam", "hanoi", "ho chi minh")),
    ("India", ("india", "bengaluru", "bangalore", "mumbai", "delhi", "gurgaon", "pune", "hyderabad", "chennai")),
)
DEPARTURE = ("leaves", "quits", "steps down", "resigns", "departs", "former", "ex-")
FOUNDING = ("founder", "launches", "startup", "stealth", "building", "new venture")
FUNDING = ("seed", "raises", "raised", "funding", "pre-seed")
EXCLUDED = ("webinar", "opinion", "how to", "podcast")
STAGES = ("new", "contacted", "replied", "meeting", "passed")
# A word that stands twice in its list counts twice.
STEALTH = (("stealth", 1), ("building something", 1), ("founder", 2), ("new venture", 1), ("co-founder", 1))
