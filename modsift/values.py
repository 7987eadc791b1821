"""Patterns, word lists, thresholds and labels that decide results."""

# --- fixed values: cleaning patterns (Java regex dialect) -------------------
HTML_TAG = r"<[^>]+>"
HTML_TAG_OR_EMPTY = r"<[^>]*>"
URL = r"https?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+"
EMAIL = r"[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}"
PHONE = r"1[3-9]\d{9}|\d{3,4}-\d{7,8}"
SPECIAL_CHARS = "[^一-龥" + r"""\w\s.,!?;:"'()\[\]{}\-]"""
WHITESPACE = r"\s+"

# --- fixed values: character classes -----------------------------------------
HAN_NARROW = "一-龥"   # features and cleaning
HAN_WIDE = "一-鿿"     # filters and language detection
SENTENCE_END_CHARS = ".!?。！？"
FULL_WIDTH_SENTENCE_CHARS = "。！？"
PARAGRAPH_BREAK = "\n\n+"
READABLE_PUNCTUATION = "，。！？；：\"\"''（）【】"
MENTION = "@[一-龥\\w]+"
TOPIC_TAG = r"#[^#\s]+#"
SITE_URL = r"https?://[\w\.-]*zhihu\.com[^\s]*"
ANCHORED_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SIMPLE_TOKEN_BREAK = r"[\s\p{Punct}]+"

# --- fixed values: collection limits in bytes (low, high, no_short, no_long) --
COLLECTION_LIMITS = {
    "file": (5, 2000, 10, 500),
    "web": (5, 1000, 20, 500),
    "api": (5, 500, 10, 200),
}
TEXT_COLUMN_NAMES = ["content", "text", "message", "comment", "description", "body"]
DEFAULT_SELECTORS = [
    "p", ".comment", ".content", ".text", ".description", ".review",
    "[class*='comment']", "[class*='content']", "[class*='text']",
    "article", ".post", ".message", ".reply",
]
LINK_EXCLUDES = [
    ".jpg", ".jpeg", ".png", ".gif", ".pdf", ".doc", ".zip",
    "javascript:", "mailto:", "tel:",
]
FORUM_EXCLUDES = ["广告", "推广", "spam", "删除"]

# --- fixed values: lexicons ----------------------------------------------------
POSITIVE_WORDS = [
    "好", "棒", "优秀", "完美", "满意", "喜欢", "爱", "赞", "支持", "推荐",
    "good", "great", "excellent", "perfect", "amazing", "wonderful", "love", "like",
]
NEGATIVE_WORDS = [
    "坏", "差", "糟糕", "失望", "讨厌", "恨", "反对", "批评", "抱怨", "问题",
    "bad", "terrible", "awful", "hate", "dislike", "problem", "issue", "wrong",
]
SENSITIVE_WORDS = ["敏感词1", "敏感词2", "敏感词3"]
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "里",
    "吧", "啊", "呢", "吗", "哦", "嗯", "哈", "呵", "嘿", "嗨",
]
SYNONYMS = {
    "好": ["棒", "优秀", "不错", "很好"],
    "坏": ["差", "糟糕", "不好", "恶劣"],
    "大": ["巨大", "庞大", "很大", "硕大"],
    "小": ["微小", "细小", "很小", "迷你"],
    "快": ["迅速", "快速", "敏捷", "急速"],
    "慢": ["缓慢", "迟缓", "缓缓", "徐徐"],
    "good": ["great", "excellent", "wonderful", "fantastic"],
    "bad": ["terrible", "awful", "horrible", "poor"],
    "big": ["large", "huge", "enormous", "massive"],
    "small": ["tiny", "little", "mini", "compact"],
    "fast": ["quick", "rapid", "swift", "speedy"],
    "slow": ["sluggish", "gradual", "leisurely", "unhurried"],
}
COMMON_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "个", "上", "也", "很", "到", "说", "要", "去",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to",
    "for", "of", "with", "by", "from", "up", "about", "into", "through", "during",
]
LOG_ERROR_PATTERNS = [
    "ERROR", "FATAL", "Exception", "Error", "Failed", "Timeout",
    "Connection refused", "Out of memory", "Disk full",
]
VIOLATION_TYPES = [
    "NORMAL", "PORNOGRAPHY", "VIOLENCE", "ADVERTISEMENT", "SPAM", "HATE_SPEECH", "OTHER",
]
RULE_LABELS = {
    "normal": 0, "spam": 1, "offensive": 2, "political": 3, "advertising": 4, "inappropriate": 5,
}

# --- fixed values: labels and templates ------------------------------------------
NO_TITLE = "无标题"
UNKNOWN_TYPE = "未知"
TYPE_DESCRIPTIONS = {"question": "问题", "answer": "回答", "article": "文章", "topic": "话题"}
INSTRUCTIONS = {
    "QUESTION_ANSWER": "请根据以下问题提供准确、详细的回答：",
    "INSTRUCTION_FOLLOWING": "请按照以下指令执行任务：",
    "CONVERSATION": "请参与以下对话并提供合适的回复：",
    "KNOWLEDGE_QA": "请基于你的知识回答以下问题：",
    "REASONING": "请分析以下问题并提供逻辑推理：",
    "CREATIVE_WRITING": "请根据以下要求进行创意写作：",
}
DEFAULT_INSTRUCTION = "请回答以下问题："
SIMPLE_INSTRUCTION = "请根据以下问题生成高质量的回答："
QUESTION_PREFIX = "问题："
TOPIC_PREFIX = "\n话题："
CONTEXT_PREFIX = "\n背景："
ANSWER_PREFIX = "回答："
MODERATION_CLASSES = ("正常", "疑似违规", "违规")

# --- fixed values: forum page rules ------------------------------------------------
FORUM_SOURCE = "zhihu"
FORUM_MIN_BYTES = {"question": 0, "answer": 50, "answers": 100, "search": 0, "topic": 0, "general": 20}
FORUM_SELECTORS = {
    "question_title": ".QuestionHeader-title",
    "question_detail": ".QuestionRichText",
    "answer": ".RichContent-inner",
    "author": ".AuthorInfo-name",
    "votes": ".VoteButton--up .Button-label",
    "search_card": ".SearchResult-Card",
    "search_title": ".SearchResult-title",
    "search_excerpt": ".SearchResult-excerpt",
    "topic_item": ".ContentItem",
    "topic_title": ".ContentItem-title",
}
FORUM_TARGETS = {  # kind -> (max_count, min_votes)
    "question": (1000, 0),
    "answer": (2000, 10),
    "search": (500, 0),
    "topic": (1000, 0),
}
FORUM_TARGET_LENGTH = (50, 10000)
FORUM_TARGET_EXCLUDES = ["广告", "推广", "spam"]
