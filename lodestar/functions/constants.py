"""Fixed values that results depend on: word lists, limits and formats."""

# Keywords that ban an item.
BANNED_KEYWORDS = (
    "suicide", "self harm", "self-harm", "mass shooting", "dead body", "graphic gore", "graphic violence",
    "rape", "child abuse", "terrorist", "terrorism", "sexual assault",
)

# Words that do not count when two topics are compared.
TOPIC_STOP = (
    "the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "from", "new", "latest", "official",
    "video", "youtube", "shorts", "short", "update", "news", "story", "trailer",
)

# Words too generic to be a term of a topic.
GENERIC_WORDS = (
    "the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "from", "at", "by", "is", "are", "was",
    "were", "this", "that", "these", "those", "new", "latest", "official", "video", "youtube", "short", "shorts",
    "news", "update", "story", "facts", "fact", "viral", "trending", "trend", "today", "now", "breaking", "watch",
    "explained", "explaining", "explanation", "why", "how", "what", "when", "over", "live", "full", "real", "thing",
    "things", "really", "just", "still", "one", "two", "three", "part", "section", "here", "lets", "let", "you",
    "your", "they", "them", "their",
)

# Words left out of media queries.
QUERY_STOP = (
    "the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "from", "at", "by", "is", "are", "was",
    "were", "this", "that", "these", "those", "new", "latest", "official", "video", "news", "update", "today", "now",
    "breaking", "short", "shorts",
)

# Words left out of a research subject.
SUBJECT_STOP = (
    "the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "this", "that", "is", "are", "was", "were",
    "new", "latest", "official", "video", "shorts", "explained", "explanation", "why", "how",
)

# Words that are never an anchor of a subject.
ANCHOR_STOP = (
    "this", "that", "these", "those", "combo", "copycat", "remains", "ineffective", "official", "latest", "video",
    "shorts", "short", "watch", "viral", "trending", "trend", "today", "now", "breaking", "update", "updates",
    "explained", "explanation", "why", "how", "what", "when", "where", "who", "which", "movie", "movies", "scene",
    "scenes", "clip", "clips", "edit", "edits", "editz",
)

# What a verdict may say.
CONTENT_DOMAINS = ("MOVIE", "ANIME")
CONTENT_TYPES = (
    "EXPLAINER", "BREAKDOWN", "ANALYSIS", "NEWS_EXPLAINER", "CONTEXT", "TIMELINE", "HOW_IT_WORKS", "RECAP",
    "TREND_EXPLAINER",
)
CALL_TO_ACTION = ("CTA", "CALL_TO_ACTION")

# Domains that media never comes from.
BLOCKED_DOMAINS = (
    "shutterstock.com", "www.shutterstock.com", "istockphoto.com", "www.istockphoto.com", "gettyimages.com",
    "www.gettyimages.com", "pond5.com", "www.pond5.com", "storyblocks.com", "www.storyblocks.com", "stock.adobe.com",
    "www.stock.adobe.com", "adobestock.com", "www.adobestock.com", "alamy.com", "www.alamy.com",
)

# Limits.
WINDOW_HOURS = 72
MAX_SECONDS = 10_000
MAX_BYTES = 2 * 1024 * 1024 * 1024
WORDS_PER_MINUTE = 110
NEAR_BITS = 6
NEAR_SHARE = 0.5

# Tokens of error messages, in the order they are looked for.
AUTH_ERRORS = ("401", "403", "PERMISSION_DENIED", "UNAUTHENTICATED", "API KEY")
TRANSIENT_ERRORS = (
    "408", "429", "500", "502", "503", "504", "RESOURCE_EXHAUSTED", "UNAVAILABLE", "INTERNAL", "DEADLINE_EXCEEDED",
    "MODEL_NOT_FOUND", "NOT_FOUND", "OVERLOADED", "RATE LIMIT", "RATE_LIMIT", "QUOTA", "TIMED OUT", "TIMEOUT",
    "SERVICE UNAVAILABLE",
)

# Pixels of the portrait and landscape targets, and openings of narration templates.
TARGET_AREA = 1080 * 1920
TEMPLATE_OPENINGS = ("Start with", "Deep explanation", "Open with")

# File endings of images and of clips.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp")
CLIP_ENDINGS = (".mp4",)

# Seconds of the shortest even segment, of a still and of an opening; rounds of even segments, and pieces of whole clips at most.
LEAST_SEGMENT, STILL_SECONDS, OPENING_SECONDS = 1.5, 2.5, 3.0
CYCLES, MOST_PIECES = 20, 201
