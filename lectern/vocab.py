"""Vocabularies and constants of the question-answering domain.

Every operator takes its vocabulary as an argument; the tables here are the defaults. They are
small fixed tables, so operators fold them into the plan as literals instead of joining them.
"""

from __future__ import annotations

# --- Fixed values: retrieval constants -------------------------------------------------------
VECTOR_CANDIDATES = 40
KEYWORD_CANDIDATES = 40
HYBRID_CANDIDATES = 50
STRONG_SCORE = 8
WEAK_SCORE = 1
STRONG_KEYWORD_SCORE = 6
RRF_K = 60
RRF_WEIGHT = 100
KEYWORD_SCORE_CAP = 20
HYBRID_SCORE_CAP = 25
BM25_K1 = 1.5
BM25_B = 0.75
BM25_AVG_LENGTH = 180
PHRASE_POINTS = 10
KEYWORD_POINTS = 1
ARTICLE_POINTS = 3
SECTION_POINTS = 8
MAX_REWRITES = 4
SECTION_LETTERS = "ABCDEF"
CHUNK_CHARS = 1000

# --- Fixed values: session and memory constants ----------------------------------------------
MAX_TURNS = 20
RECENT_TURNS = 4
COMPACTION_TOKENS = 1600
SUMMARY_TOKENS = 260
CONTEXT_TOKENS = 1200
MEMORY_TOP_K = 3
MEMORY_CHARS = 240
SESSION_TTL_SECONDS = 86_400
MEMORY_TTL_SECONDS = 2_592_000
DELTA_CHARS = 24


# --- Fixed values: question vocabulary -------------------------------------------------------
# Source term -> search words appended to a question, in order of application.
QUESTION_SYNONYMS = {
    "红旗": "red flag",
    "黄旗": "yellow flag",
    "安全车": "safety car",
    "虚拟安全车": "virtual safety car vsc",
    "封闭维修区": "parc ferme",
    "封闭维修": "parc ferme",
    "不安全释放": "unsafe release",
    "违规释放": "unsafe release",
    "维修区超速": "pit lane speed limit speeding penalty",
    "维修区限速": "pit lane speed limit",
    "维修区速度": "pit lane speed limit",
    "危险驾驶": "dangerous driving penalty stewards incident",
    "危险返回赛道": "dangerous rejoin track penalty stewards",
    "不安全驾驶": "dangerous driving penalty stewards incident",
    "赛会干事": "stewards penalty investigation",
    "干事调查": "stewards investigation penalty",
    "处罚": "penalty sanctions stewards",
    "罚时": "time penalty stewards",
    "底板": "plank",
    "木板": "plank",
}

# Section -> words in a question that make the section preferred.
SECTION_WORDS = {
    "Section A": ["general", "principles", "governance", "applicable", "code of ethics", "disciplinary"],
    "Section B": [
        "unsafe", "release", "parc", "ferme", "pit", "lane", "penalty", "stewards", "dangerous", "driving",
        "incident", "investigation", "race", "qualifying", "sprint", "red", "flag", "yellow", "safety", "vsc",
        "virtual safety car", "suspension",
    ],
    "Section C": [
        "plank", "wear", "thickness", "skid", "floor", "technical", "geometry", "bodywork", "ride", "height",
    ],
}

# (any of these in the question, phrase to look for), in order.
PHRASE_RULES = [
    (["parc ferme", "parc fermé"], "parc ferme"),
    (["unsafe release"], "unsafe release"),
    (["red flag"], "red flag"),
    (["yellow flag"], "yellow flag"),
    (["safety car"], "safety car"),
    (["virtual safety car", " vsc"], "virtual safety car"),
    (["pit lane speed", "pit lane speeding"], "pit lane speed"),
    (["dangerous driving"], "dangerous driving"),
    (["track limits"], "track limits"),
    (["impeding"], "impeding"),
]

# Question term -> search keywords that replace it.
KEYWORD_EXPANSIONS = {
    "breaches": ["breach", "breaches", "sanctions", "adjudication", "investigations"],
    "breach": ["breach", "breaches", "sanctions", "adjudication", "investigations"],
    "handled": ["handled", "handling", "adjudication", "sanctions", "investigations"],
    "unsafe": ["unsafe", "danger", "endanger", "risk"],
    "dangerous": ["dangerous", "danger", "endanger", "unsafe", "incident", "penalty"],
    "driving": ["driving", "driver", "incident", "penalty"],
    "release": ["release", "released", "pit"],
    "pit": ["pit", "lane", "entry", "exit", "speed", "limit"],
    "lane": ["lane", "pit", "speed", "limit"],
    "speed": ["speed", "speeding", "limit", "pit", "lane"],
    "speeding": ["speeding", "speed", "limit", "pit", "lane"],
    "limit": ["limit", "speed", "speeding", "pit", "lane"],
    "penalty": ["penalty", "penalties", "sanctions", "stewards", "investigation"],
    "stewards": ["stewards", "penalty", "investigation", "incident", "decision"],
    "investigation": ["investigation", "stewards", "incident", "penalty"],
    "incident": ["incident", "investigation", "stewards", "penalty"],
    "parc": ["parc", "ferme", "restricted"],
    "ferme": ["parc", "ferme", "restricted"],
    "principles": ["principles", "overview", "application"],
    "general": ["general", "principles", "application"],
    "plank": ["plank", "wear", "thickness", "skid", "block"],
    "red": ["red", "flag", "suspension", "stopped"],
    "yellow": ["yellow", "flag", "warning", "marshal"],
    "flag": ["red", "yellow", "flag", "suspension", "stopped"],
    "safety": ["safety", "car", "vsc", "deployment"],
    "virtual": ["virtual", "safety", "car", "vsc"],
}

# Rewriting of questions that hold CJK text: (any of these tokens, query to add), in order.
REWRITE_SUFFIX = "FIA Formula 1 regulations"
REWRITE_FAMILIES = [
    (
        ["比赛", "车手", "驾驶", "处罚", "罚", "赛道", "维修区", "旗", "安全车", "干事", "阻挡", "挡车", "超速", "事故"],
        "FIA Formula 1 Sporting Regulations driver conduct penalties stewards investigation race control",
    ),
    (
        ["技术", "赛车", "底板", "车身", "前翼", "后翼", "动力单元", "尺寸", "重量", "合规"],
        "FIA Formula 1 Technical Regulations car legality bodywork dimensions power unit compliance",
    ),
    (
        ["成本", "预算", "财务", "成本帽", "审计"],
        "FIA Formula 1 Financial Regulations cost cap reporting audit breach",
    ),
    (
        ["测试", "风洞", "仿真", "运营", "人员", "设施"],
        "FIA Formula 1 Operational Regulations testing wind tunnel simulation personnel restrictions",
    ),
]
REWRITE_DEFAULTS = [
    "FIA Formula 1 Sporting Regulations stewards penalties race control",
    "FIA Formula 1 Technical Regulations car legality compliance",
]

# --- Fixed values: document cleaning and chunking --------------------------------------------
HEADING_PATTERN = r"(?i)^(ARTICLE\s+\d+[A-Z]?(?:\.\d+)*|[A-F]\d+(?:\.\d+)*)\b"
SECTION_PATTERN = r"(?i)section\s*([a-f])"
TITLE_SECTION_PATTERN = r"(?i)(Section\s+[A-F])"
OVERVIEW_ARTICLE_PATTERN = r"(?i)^[A-F]\d+(?:\.\d+)?$"
BOILERPLATE_EXACT_UPPER = ["SECTION A: GENERAL REGULATORY PROVISIONS"]
BOILERPLATE_PREFIXES = [
    "2026 Formula 1: General Regulatory Provisions",
    "Issue 03",
    "Status:",
    "Date:",
    "WMSC approval date:",
]
BOILERPLATE_PATTERN = r"^(A\d+|\d+)$"
SKIP_PAGE_MARKERS_UPPER = ["CONTENTS:", "CONVENTION:"]
INDEX_LINE_PREFIXES = ["ARTICLE ", "APPENDIX "]
INDEX_TOKEN_PREFIX = "A"
MIN_INDEX_LINES = 10
MAX_SENTENCE_LINES = 2
SENTENCE_LINE_CHARS = 60

# --- Fixed values: article insight ------------------------------------------------------------
# (alias, name), in order; kept per entity type.
ENTITY_ALIASES = {
    "driver": [
        ("max verstappen", "Max Verstappen"),
        ("verstappen", "Max Verstappen"),
        ("lewis hamilton", "Lewis Hamilton"),
        ("hamilton", "Lewis Hamilton"),
        ("lando norris", "Lando Norris"),
        ("norris", "Lando Norris"),
        ("charles leclerc", "Charles Leclerc"),
        ("leclerc", "Charles Leclerc"),
        ("oscar piastri", "Oscar Piastri"),
        ("piastri", "Oscar Piastri"),
        ("george russell", "George Russell"),
        ("russell", "George Russell"),
        ("fernando alonso", "Fernando Alonso"),
        ("alonso", "Fernando Alonso"),
        ("carlos sainz", "Carlos Sainz"),
        ("sainz", "Carlos Sainz"),
        ("adrian newey", "Adrian Newey"),
        ("newey", "Adrian Newey"),
    ],
    "team": [
        ("red bull", "Red Bull Racing"),
        ("red bull racing", "Red Bull Racing"),
        ("ferrari", "Ferrari"),
        ("mclaren", "McLaren"),
        ("mercedes", "Mercedes"),
        ("aston martin", "Aston Martin"),
        ("williams", "Williams"),
        ("alpine", "Alpine"),
        ("haas", "Haas"),
        ("sauber", "Sauber"),
        ("audi", "Audi"),
        ("cadillac", "Cadillac"),
    ],
    "circuit": [
        ("silverstone", "Silverstone"),
        ("spa", "Spa-Francorchamps"),
        ("spa-francorchamps", "Spa-Francorchamps"),
        ("monza", "Monza"),
        ("monaco", "Monaco"),
        ("barcelona", "Barcelona-Catalunya"),
        ("hungaroring", "Hungaroring"),
        ("interlagos", "Interlagos"),
    ],
}

# (key, label, keywords), in order; the first of equal counts wins.
CATEGORY_RULES = [
    (
        "driver_market",
        "车手动向",
        ["contract", "future", "seat", "transfer", "move", "stay", "one-team driver", "career"],
    ),
    (
        "race_weekend",
        "比赛周末动态",
        ["practice", "qualifying", "sprint", "grand prix", "race weekend", "session", "weather"],
    ),
    (
        "technical",
        "技术与赛车开发",
        ["upgrade", "floor", "plank", "technical", "wing", "aerodynamic", "ride height", "power unit"],
    ),
    (
        "team_operations",
        "车队运营与管理",
        ["team principal", "management", "boss", "factory", "strategy team", "operations"],
    ),
    (
        "commercial",
        "商业与品牌活动",
        ["store", "pop-up", "sponsor", "partnership", "livery", "launch", "event"],
    ),
    (
        "race_control",
        "赛会控制与处罚",
        [
            "red flag", "yellow flag", "safety car", "vsc", "penalty", "stewards", "investigation",
            "unsafe release",
        ],
    ),
]
DIRECT_CATEGORY = ("race_control", "赛会控制与处罚")
DEFAULT_CATEGORY = ("general_news", "综合新闻")
POSSIBLE_CATEGORIES = ["technical", "race_weekend"]
DIRECT_TERMS = [
    "red flag", "yellow flag", "safety car", "virtual safety car", "vsc", "penalty", "stewards",
    "investigation", "unsafe release", "disqualification", "parc ferme", "technical infringement", "plank",
    "ride height",
]
POSSIBLE_TERMS = ["strategy", "protest", "incident", "contact", "collision", "appeal", "directive"]
RELEVANCE_REASONS = {
    "direct": "新闻直接包含规则或裁判相关术语：",
    "possible": "新闻可能涉及规则背景，命中了术语：",
    "category": "新闻属于比赛周末或技术动态，后续可能需要结合规则解释。",
    "none": "新闻主要属于资讯或人物动态，不需要默认关联 FIA 规则检索。",
}
TOPIC_REASON = "新闻内容命中了关键词："

# (key, title, keywords, questions), in order.
TOPICS = [
    (
        "red_flag",
        "红旗与比赛暂停",
        ["red flag", "race suspended", "session suspended", "红旗", "暂停"],
        [
            "What is the red flag procedure in Formula 1?",
            "When can the Race Director suspend a session or race?",
        ],
    ),
    (
        "safety_car",
        "安全车与虚拟安全车",
        ["safety car", "virtual safety car", "vsc", "安全车", "虚拟安全车"],
        [
            "What is the safety car procedure in Formula 1?",
            "What is the virtual safety car procedure in Formula 1?",
        ],
    ),
    (
        "unsafe_release",
        "维修区不安全释放",
        ["unsafe release", "pit lane incident", "pit lane", "不安全释放", "维修区"],
        [
            "What counts as an unsafe release in Formula 1?",
            "What penalties apply for an unsafe release?",
        ],
    ),
    (
        "parc_ferme",
        "封闭维修区",
        ["parc ferme", "封闭维修", "setup change", "set-up change"],
        [
            "What are the parc ferme restrictions in Formula 1?",
            "When can a team change car setup under parc ferme conditions?",
        ],
    ),
    (
        "stewards_penalty",
        "赛会干事与处罚",
        ["penalty", "stewards", "investigation", "summoned", "处罚", "调查"],
        [
            "How do the stewards handle penalties in Formula 1?",
            "What penalty options are available to FIA stewards?",
        ],
    ),
    (
        "technical_compliance",
        "技术合规与底板",
        ["plank", "floor", "ride height", "disqualification", "technical", "底板", "技术违规"],
        [
            "What are the plank wear limits in Formula 1?",
            "What technical infringements can lead to disqualification in Formula 1?",
        ],
    ),
]
GENERIC_QUESTIONS = [
    "What Formula 1 sporting or technical rules are relevant to this news: %s?",
    "What FIA Formula 1 regulations could be relevant to the incident described in: %s?",
]

# --- Fixed values: web article extraction -----------------------------------------------------
ARTICLE_NODE_TYPE = "NewsArticle"
STATE_NODE_KEYS = ["body", "metaDescription", "description"]
BODY_STOP_MARKERS = [
    "READ MORE:", "Related Articles", "More news", "More videos", "Latest News", "Latest Video", "Feature",
    "Gallery",
]
BODY_SKIP_PARTS = ["Show more tags", "READ MORE:", "Related Articles"]
BODY_SKIP_PREFIXES = ["Jun ", "Jul ", "Aug "]
MIN_BODY_PART_CHARS = 20

# --- Fixed values: routing --------------------------------------------------------------------
EXPLICIT_RULE_WORDS = ["regulation", "rule", "rules", "technical directive", "规则", "条例", "技术指令"]
STRATEGY_WORDS = [
    "strategy", "pit now", "pit stop", "pit", "tyre", "tire", "degradation", "pit under", "undercut", "overcut",
    "track position", "box now", "should pit", "策略", "进站", "进坑", "轮胎", "衰退", "赛道位置", "是否该进站",
    "该不该进站",
]
RULE_WORDS = [
    "regulation", "rule", "parc ferme", "unsafe release", "red flag", "safety car", "virtual safety car", "vsc",
    "plank", "technical directive", "pit lane speed", "pit lane speeding", "speeding in the pit lane",
    "dangerous driving", "driving infringement", "penalty", "stewards", "investigation", "规则", "条例", "红旗",
    "黄旗", "安全车", "虚拟安全车", "封闭维修区", "底板", "技术规则", "比赛规则", "维修区超速", "维修区限速",
    "维修区速度", "维修区通道", "危险驾驶", "危险返回赛道", "不安全驾驶", "罚时", "罚退", "处罚", "赛会干事",
    "干事调查", "事故调查", "sectiona", "section a", "sectionb", "section b", "sectionc", "section c", "大体规则",
    "规则是什么样", "分几部分",
]
RACE_WORDS = [
    "schedule", "calendar", "grand prix", "race weekend", "next race", "last race", "previous race", "standings",
    "championship", "drivers", "driver", "constructors", "constructor", "team", "teams", "leader", "leading",
    "who leads", "who is first", "赛程", "赛历", "比赛", "大奖赛", "积分榜", "积分", "车手", "车队", "排名", "排第",
    "榜首", "第一名", "领跑", "领先", "维斯塔潘", "诺里斯", "勒克莱尔", "拉塞尔", "汉密尔顿", "皮亚斯特里", "法拉利",
    "迈凯伦", "红牛", "梅奔", "下一站", "下一场", "上一站", "上一场", "排位",
]
NEWS_WORDS = ["news", "today", "paddock", "headline", "latest", "新闻", "今天", "围场", "动态", "消息"]
FOLLOW_UP_WORDS = [
    "那呢", "然后呢", "这个呢", "那个呢", "他", "她", "它", "这篇", "这条", "这个", "那个", "what about",
    "how about", "and that", "then what", "it ", "he ", "she ", "that ", "this ",
]
BARE_QUESTIONS = ["?", "？", "??", "？？"]
SHORT_FOLLOW_UPS = ["呢", "然后", "然后呢", "那", "那呢", "这个", "那个"]
SHORT_FOLLOW_UP_TOKENS = ["呢", "他", "她", "它", "这", "那"]
SHORT_FOLLOW_UP_CHARS = 18
CORRECTION_WORDS = ["不是第一", "不是第1", "我问你", "刚才问的是"]
RANK_REFERENCE_PATTERN = r"(前\s*\d+\s*名|前[一二三四五六七八九十]+名|第\s*\d+\s*名|第[一二三四五六七八九十]+名)"

# (any of these in the message, action), in order; used for the race tool.
RACE_ACTIONS = [
    (["constructor", "team standings", "constructors", "team", "车队"], "get_constructor_standings"),
    (
        [
            "driver", "drivers", "championship", "车手", "积分", "verstappen", "norris", "leclerc", "russell",
            "hamilton", "piastri", "维斯塔潘", "诺里斯", "勒克莱尔", "拉塞尔", "汉密尔顿", "皮亚斯特里",
        ],
        "get_driver_standings",
    ),
    (["previous", "last race", "上一站", "上一场"], "get_previous_race"),
    (["next", "下一站", "下一场"], "get_next_race"),
    (["time", "date", "when", "时间", "日期", "几点"], "get_next_race"),
]
DEFAULT_RACE_ACTION = "list_schedule"
TOOLS = {
    "news": "news_tool",
    "race": "race_tool",
    "regulation": "regulation_tool",
    "strategy": "strategy_tool",
    "general": "general_tool",
}
DEFAULT_ACTIONS = {
    "news": "list_recent",
    "regulation": "ask",
    "strategy": "analyze",
    "general": "answer",
}
SUPPORTED_ACTIONS = {
    "news": ["list_recent", "get_article", "get_insights", "get_rules_analysis"],
    "race": [
        "list_schedule", "get_next_race", "get_previous_race", "get_driver_standings",
        "get_constructor_standings",
    ],
    "regulation": ["ask"],
    "strategy": ["analyze"],
    "general": ["answer"],
}
NEWS_LIMIT = 5
ARTICLE_ID_GATE = ["news", "article", "新闻", "文章"]
ARTICLE_ID_PATTERN = r"(?:article|news|新闻|文章)\s*#?\s*(\d+)"
ARTICLE_ACTIONS = [
    (["rule", "rules", "regulation", "规则", "条例", "关联"], "get_rules_analysis"),
    (["insight", "analysis", "analyze", "分析", "解读"], "get_insights"),
]
CASUAL_MESSAGES = ["你好", "您好", "hello", "hi", "hey", "你是谁", "你能做什么", "你可以做什么"]
CASUAL_TOKENS = ["谢谢", "thanks", "thank you", "不对", "不对不对"]
UNRELATED_TOKENS = ["alien", "extraterrestrial", "ufo", "外星"]
AUTHORITATIVE_TOKENS = [
    "latest", "today", "now", "current", "standings", "schedule", "calendar", "next race", "previous race",
    "news", "headline", "regulation", "rule", "rules", "2026", "最新", "今天", "现在", "当前", "积分", "积分榜",
    "赛程", "下一站", "上一站", "新闻", "规则", "条例",
]
OVERVIEW_TOKENS = [
    "overview", "summary", "summarize", "what does", "about", "大体", "大概", "概览", "总览", "主要", "内容",
    "讲了", "讲什么", "分几部分", "几部分",
]
TECHNICAL_RULE_TOKENS = ["技术规则", "技术规章"]
TECHNICAL_OVERVIEW_TOKENS = ["大概", "概览", "主要", "内容"]
TECHNICAL_SECTION = "Section C"
DOCUMENT_TOKENS = ["大体规则", "规则是什么样", "分几部分", "几部分", "整体", "总览", "概览"]
DOCUMENT_SUBJECTS = ["fia", "f1", "regulation"]
CJK_SECTION_PATTERN = r"(?i)第\s*([a-f])\s*(?:部分|章|节)"

# --- Fixed values: answer formatting ----------------------------------------------------------
DISPLAY_ZONE = "Asia/Shanghai"
DISPLAY_ZONE_LABEL = "CST"
UNKNOWN_TIME = "时间未知"
FULL_LIST_WORDS = ["完整", "全部", "所有", "全体", "full", "complete", "entire", "whole"]
STANDINGS_WORDS = ["积分榜", "排名", "standings"]
SCHEDULE_WORDS = ["赛历", "赛程", "calendar", "schedule"]
FULL_SEASON_WORDS = ["全年", "今年", "赛季", "season"]
SESSION_TIME_WORDS = [
    "时间", "日期", "几点", "具体", "排位", "练习", "冲刺", "session", "sessions", "time", "date", "when",
    "qualifying", "practice", "sprint",
]
CHINESE_DIGITS = {
    "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
}
# (pattern, position), in order of testing.
POSITION_WORDS = [
    ("第一名", 1), ("第一", 1), ("第1名", 1), ("第1", 1), ("1st", 1), ("first", 1),
    ("第二名", 2), ("第二", 2), ("第2名", 2), ("第2", 2), ("2nd", 2), ("second", 2),
    ("第三名", 3), ("第三", 3), ("第3名", 3), ("第3", 3), ("3rd", 3), ("third", 3),
    ("第四名", 4), ("第四", 4), ("第4名", 4), ("第4", 4), ("4th", 4), ("fourth", 4),
    ("第五名", 5), ("第五", 5), ("第5名", 5), ("第5", 5), ("5th", 5), ("fifth", 5),
]
TOP_N_PATTERN = r"(?:前|top)\s*(\d+)\s*名?"
TOP_N_CHINESE_PATTERN = r"前\s*([一二两三四五六七八九十]+)\s*名?"
POSITION_PATTERN = r"第\s*(\d+)\s*名?"
POSITION_ENGLISH_PATTERN = r"\b(\d+)(st|nd|rd|th)\b"
STANDING_DRIVER_ALIASES = [
    ("维斯塔潘", "Max Verstappen"),
    ("max verstappen", "Max Verstappen"),
    ("verstappen", "Max Verstappen"),
    ("诺里斯", "Lando Norris"),
    ("norris", "Lando Norris"),
    ("勒克莱尔", "Charles Leclerc"),
    ("leclerc", "Charles Leclerc"),
    ("拉塞尔", "George Russell"),
    ("george russell", "George Russell"),
    ("russell", "George Russell"),
    ("汉密尔顿", "Lewis Hamilton"),
    ("hamilton", "Lewis Hamilton"),
    ("安东内利", "Andrea Kimi Antonelli"),
    ("antonelli", "Andrea Kimi Antonelli"),
    ("kimi antonelli", "Andrea Kimi Antonelli"),
    ("皮亚斯特里", "Oscar Piastri"),
    ("piastri", "Oscar Piastri"),
    ("阿隆索", "Fernando Alonso"),
    ("alonso", "Fernando Alonso"),
    ("塞恩斯", "Carlos Sainz"),
    ("sainz", "Carlos Sainz"),
]
STANDING_TEAM_ALIASES = [
    ("红牛", "Red Bull"),
    ("red bull", "Red Bull"),
    ("梅奔", "Mercedes"),
    ("奔驰", "Mercedes"),
    ("mercedes", "Mercedes"),
    ("法拉利", "Ferrari"),
    ("ferrari", "Ferrari"),
    ("迈凯伦", "McLaren"),
    ("mclaren", "McLaren"),
    ("威廉姆斯", "Williams"),
    ("williams", "Williams"),
    ("阿斯顿马丁", "Aston Martin"),
    ("aston martin", "Aston Martin"),
    ("哈斯", "Haas"),
    ("haas", "Haas"),
    ("索伯", "Audi"),
    ("奥迪", "Audi"),
    ("audi", "Audi"),
    ("alpine", "Alpine"),
    ("rb", "RB"),
]
SECTION_SUMMARIES = {
    "Section A": "General Provisions，主要说明锦标赛治理、适用原则、参赛相关定义和总体合规框架。",
    "Section B": "Sporting Regulations，覆盖比赛周末、练习/排位/正赛程序、车手行为、赛事控制、处罚和申诉等竞技规则。",
    "Section C": "Technical Regulations，覆盖赛车尺寸、空气动力、底盘、动力单元相关接口、安全结构和技术合规要求。",
    "Section D": "Financial Regulations (F1 Teams)，覆盖车队成本帽、申报、审计、调整和违规处理。",
    "Section E": "Financial Regulations (Power Unit Manufacturers)，覆盖动力单元制造商成本帽、申报、审查和处罚。",
    "Section F": "Operational Regulations，覆盖测试、运营限制、风洞/仿真、人员与设施等运营要求。",
}

# --- Fixed values: calendar and standings documents ---------------------------------------------
SESSION_FIELDS = [
    ("FirstPractice", "Practice 1"),
    ("SecondPractice", "Practice 2"),
    ("ThirdPractice", "Practice 3"),
    ("SprintQualifying", "Sprint Qualifying"),
    ("Sprint", "Sprint"),
    ("Qualifying", "Qualifying"),
]
MAIN_SESSION = "Race"
UNKNOWN_TEAM = "Unknown"

# --- Fixed values: memory markers ---------------------------------------------------------------
PREFERENCE_MARKERS = [
    "remember", "from now on", "default", "prefer", "use chinese", "use english", "记住", "以后", "默认", "偏好",
    "喜欢", "关注", "用中文", "用英文",
]
INTEREST_MARKERS = ["关注", "follow", "interested"]
CONFIDENCE_WITH_REPLY = 0.8
CONFIDENCE_WITHOUT_REPLY = 0.6
