"""They must equal the published behaviour for right results."""

from __future__ import annotations

# The usual English stop words. Contractions are left out: the
# cleaner removes apostrophes, so an entry that holds one can never match.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will
just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Words of social platforms that carry no content.
SOCIAL_WORDS = """
rt retweet via follow following followers like likes share shares comment
comments dm pm tweet tweets twitter instagram facebook linkedin tiktok youtube
snapchat
""".split()

STOP_WORDS = ENGLISH_STOP_WORDS + SOCIAL_WORDS

# Entity dictionaries, in output order.
COMPANIES = ["apple", "google", "microsoft", "amazon", "tesla", "meta", "netflix", "nvidia"]
TECHNOLOGIES = ["ai", "blockchain", "bitcoin", "ethereum", "machine learning", "deep learning"]

# Topics of interest (title, description), in match order.
TOPICS_OF_INTEREST = [
    (
        "Technology Trends",
        "Discussions about AI, machine learning, blockchain, and emerging technologies",
    ),
    ("Market Analysis", "Stock market trends, cryptocurrency, financial news and analysis"),
    ("Breaking News", "Major news events, political developments, and current affairs"),
    (
        "Product Launches",
        "New product announcements, startup launches, and business developments",
    ),
]

# Hashtag (lower case) -> topic.
HASHTAG_TOPICS = {
    "ai": "Technology Trends",
    "machinelearning": "Technology Trends",
    "blockchain": "Technology Trends",
    "innovation": "Technology Trends",
    "stocks": "Market Analysis",
    "crypto": "Market Analysis",
    "trading": "Market Analysis",
    "bitcoin": "Market Analysis",
    "breakingnews": "Breaking News",
    "news": "Breaking News",
    "urgent": "Breaking News",
    "productlaunch": "Product Launches",
    "newproduct": "Product Launches",
    "launch": "Product Launches",
}

# Patterns of the cleaner, on lower-cased text.
URL_PATTERN = r"https?://[!$-_a-z]+"
WWW_PATTERN = r"www\.[!$-_a-z]+"
MENTION_PATTERN = r"@[A-Za-z0-9_]+"
HASHTAG_PATTERN = r"#([A-Za-z0-9_]+)"
EMOTICON_PATTERN = r"([:\-=][)(\[\]{}|\\/DPp]|[)(\[\]{}|\\/DPp][:=\-])"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Default parameters.
SIMILARITY_THRESHOLD = 0.7
MINIMAL_SIMILARITY_THRESHOLD = 0.5
RADIUS_THRESHOLD = 0.3
MIN_CLUSTER_SIZE = 5
CLUSTER_EXPIRY_HOURS = 48
ALERT_TOPIC_SIMILARITY = 0.6
ALERT_DUPLICATE_SIMILARITY = 0.85
ALERT_COOLDOWN_HOURS = 24
WINDOW_SIZE_HOURS = 24
WINDOW_OVERLAP_HOURS = 6
MIN_COHERENCE = 0.6
LARGE_CLUSTER_SIZE = 50
QUALITY_CHECK_INTERVAL = 100
REFIT_INTERVAL = 1000
REFIT_POSTS = 100
BATCH_SIZE = 100
PROCESSING_INTERVAL_SECONDS = 30

# Texts in results that must stay as they are.
NO_TOPIC = "No Topic"
GENERAL_TOPIC = "General Discussion"
ABOUT = "Cluster about: "
NEW_ALERT = "New alert"
