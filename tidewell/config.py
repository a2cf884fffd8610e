"""Constants of indexing, ranking and crawling.

Fixed values: they must equal those of the search engine whose results this
engine reproduces."""

from __future__ import annotations

MIN_WORD_LENGTH, MAX_WORD_LENGTH = 2, 50
BM25_K1, BM25_B = 1.5, 0.75
TITLE_BOOST, DESCRIPTION_BOOST, HEADING_BOOST, ANCHOR_BOOST, URL_BOOST = 4.0, 2.0, 2.5, 3.0, 1.5
BIGRAM_BOOST = 2.0
BIGRAM_MIN_FREQ, MAX_BIGRAMS_PER_DOC = 2, 200
MAX_ENTITIES_PER_DOC, NER_TEXT_LIMIT = 50, 6000
MAX_POSITIONS, MAX_ORIGINALS = 200, 20
CONTENT_LIMIT = 50_000
DAMPING, MAX_ITERATIONS, TOLERANCE, CHECKPOINT_EVERY = 0.85, 200, 1e-8, 20
PERSONALISED_ITERATIONS = 50
DEFAULT_RESULTS_PER_PAGE = 10
SNIPPET_WINDOW, SNIPPET_WORDS = 40, 3000

CRAWL_LIMIT, MAX_DEPTH = 50_000, 6
MIN_DELAY, MAX_DELAY = 0.5, 3.0
MAX_CONTENT_SIZE = 5 * 1024 * 1024
ROBOTS_TTL_SECONDS, ROBOTS_DEFAULT_DELAY = 6 * 3600, 1.0
CRAWL_LANGUAGES = ["en", "id"]

# File extensions that are not crawled.
BLOCKED_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico",
    ".mp4", ".mp3", ".avi", ".mov", ".zip", ".tar", ".gz",
    ".exe", ".dmg", ".apk", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".css", ".js", ".woff", ".woff2", ".ttf",
]

# Query parameters that normalisation drops.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source", "campaign",
    "_ga", "mc_cid", "mc_eid", "yclid",
]

# Crawl priority by top-level domain, first match.
TLD_BOOST = [(".edu", 1.4), (".gov", 1.3), (".org", 1.1), (".com", 1.0)]

# Suffixes of the built-in stemmer, and the stop words.
SUFFIXES = ["ing", "tion", "ed", "er", "ly", "ness", "ment"]
STOP_WORDS = [
    "a", "an", "the", "this", "that", "these", "those",
    "be", "is", "are", "was", "were", "been", "being",
    "am", "will", "would", "shall", "should",
    "do", "does", "did", "done", "doing",
    "have", "has", "had", "having",
    "can", "could", "may", "might", "must", "ought",
    "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "out", "off",
    "over", "under", "again", "further", "then", "once",
    "about", "against", "along", "around", "near", "up", "down",
    "and", "but", "or", "nor", "so", "yet", "both", "either",
    "neither", "not", "no", "only", "own", "same",
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "whose",
    "get", "got", "go", "goes", "went", "come", "came",
    "make", "made", "take", "took", "put", "see", "say", "said",
    "know", "think", "look", "want", "give", "use", "find", "tell",
    "ask", "seem", "feel", "try", "leave", "call",
    "very", "just", "more", "also", "how", "all", "each", "every",
    "any", "few", "other", "some", "such", "too", "well",
    "than", "when", "where", "why", "there", "here",
    "now", "new", "old", "good", "great", "first", "last", "long",
    "little", "right", "big", "high", "different", "small",
    "one", "two", "three", "four", "five", "six", "seven", "eight",
    "nine", "ten", "http", "https", "www", "com", "org", "net", "html",
]
