"""Default word lists and constants.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(cue phrases, thresholds, labels, defaults), so it is written out plainly.
Each list is only a default: every operator takes its list as a parameter,
either a Python list or a lookup DataFrame.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour)
# ---------------------------------------------------------------------------

# Heuristic credibility (D1): clickbait cues, counted once each if present.
CLICKBAIT_PHRASES = [
    "you won't believe", "shocking", "top secret", "exposed", "miracle",
    "will blow your mind", "never seen before", "what happens next",
]
# Heuristic credibility (D1): a source is cited if either phrase occurs.
SOURCE_PHRASES = ["according to", "source:"]
# Heuristic credibility (D1): ideal length in words, weights.
CREDIBILITY_IDEAL_WORDS = 300
CREDIBILITY_W_LENGTH = 0.4
CREDIBILITY_W_SOURCE = 0.2
CREDIBILITY_W_PENALTY = 0.4
REPETITION_TOP = 3
REPETITION_MIN_COUNT = 5          # a word counts if its frequency is > 5

# Penalty credibility (D2): each occurrence costs 10 points from 100.
PENALTY_CUES = ["rumor", "unverified", "alleged", "reportedly", "according to sources"]
PENALTY_START = 100.0
PENALTY_PER_HIT = 10.0

# Bias (D3): loaded phrases and emotion words, substring counts summed.
BIAS_LOADED_PHRASES = [
    "obviously", "clearly", "undoubtedly", "needless to say", "without a doubt",
    "no one can deny", "there is no doubt", "as everyone knows", "it is a fact that",
]
BIAS_EMOTION_WORDS = [
    "disaster", "outrage", "scandal", "tragic", "heroic", "evil", "corrupt",
    "shocking", "chaotic", "miracle", "devastating", "brutal", "cowardly",
]
BIAS_CUE_WEIGHT = 0.7
BIAS_POLARITY_SCALE = 10.0
BIAS_POLARITY_WEIGHT = 0.3
BIAS_LABELS = [(2.0, "Low Bias"), (4.0, "Moderate Bias")]
BIAS_LABEL_HIGH = "High Bias"

# Sentiment (D8): label bounds (strict) and labels.
SENTIMENT_NEGATIVE_BELOW = -0.2
SENTIMENT_POSITIVE_ABOVE = 0.2

# Guards (F1): minimum lengths and the answers given below them.
GUARD_BIAS_MIN = 100
GUARD_SENTIMENT_MIN = 50
GUARD_SUMMARY_MIN = 100
GUARD_KEYWORDS_MIN = 100
NOT_ENOUGH_TEXT = "Not enough text"
TOO_SHORT_SUMMARY = "Article too short to summarize."

# Truncation before a summary model (F2).
TRUNCATE_REMOTE_WORDS = 3000
TRUNCATE_LOCAL_WORDS = 1024

# Lead summary (M1) sentences; frequency keywords (K1) count and minimum
# word length; keyword post-processing (K4) minimum phrase length and cap.
LEAD_SENTENCES = 5
FREQ_KEYWORDS_TOP = 5
FREQ_KEYWORD_MIN_LEN = 4
KEYWORDS_TOP = 10
KEYWORD_MIN_CHARS = 3
KEYWORDS_CAP = 10

# Near-duplicate threshold (U2/U3), inclusive; reported similarity digits.
DUPLICATE_THRESHOLD = 0.9
SIMILARITY_DIGITS = 4

# Link extraction (E4): links kept per site.
ARTICLE_LIMIT = 5

# Feed entry defaults.
FEED_SOURCE_DEFAULT = "Unknown"

# Article extraction defaults.
AUTHOR_DEFAULT = "Unknown"

# Per-site page rules (E2, E6, E7): host, base URL, link rule, defaults and
# element selectors, one row per site.
SITE_RULES = [
    # host, base, link_selector, link_prefix, link_contains, resolve, strip_query,
    # path_mode, title_default, author_selector, published_rule, body_selector
    dict(site="ars", host="arstechnica.com", base="https://arstechnica.com/",
         link_tag="a", link_attr_regex="", link_prefix="/", link_contains="/202",
         resolve=True, strip_query=False, path_mode="collapse",
         title_default="No Title", author_tag="a", author_attr_regex='rel="author"',
         time_required=False, body_tag="div", body_class="article-content"),
    dict(site="tc", host="techcrunch.com", base="https://techcrunch.com/",
         link_tag="a", link_attr_regex="post-block__title__link",
         link_prefix="https://techcrunch.com/", link_contains="",
         resolve=False, strip_query=False, path_mode="replace_base",
         title_default="No title", author_tag="a", author_attr_regex='rel="author"',
         time_required=True, body_tag="div", body_class="article-content"),
    dict(site="verge", host="www.theverge.com", base="https://www.theverge.com/",
         link_tag="a", link_attr_regex="", link_prefix="https://www.theverge.com/",
         link_contains="/202", resolve=False, strip_query=True, path_mode="keep",
         title_default="No title", author_tag="span", author_attr_regex="byline__name",
         time_required=False, body_tag="div",
         body_class="duet--article--article-body-components-container"),
    dict(site="wired", host="www.wired.com", base="https://www.wired.com/",
         link_tag="a", link_attr_regex='data-test-id="article-link"', link_prefix="",
         link_contains="/202", resolve=True, strip_query=False, path_mode="collapse",
         title_default="No Title", author_tag="a", author_attr_regex="byline-component__link",
         time_required=False, body_tag="article", body_class=""),
]

# HTML entities decoded natively (named ones seen in pages plus the XML set).
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"),
    ("&amp;", "&"),
]

# ---------------------------------------------------------------------------
# Parameter defaults (not fixed by the reproduced behaviour)
# ---------------------------------------------------------------------------


def default_english_stop_words() -> list[str]:
    """Spark ML's English stop-word list (used where no list is given)."""
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords("english"))
