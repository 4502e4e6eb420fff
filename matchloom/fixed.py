"""Word lists, lookup tables, patterns and formats that results depend on."""

# --- fixed values: degree keywords and their level ---
DEGREE_LEVELS = [("博士", 4), ("硕士", 3), ("研究生", 3), ("本科", 2), ("专科", 1)]

# --- fixed values: text patterns (Java syntax) ---
TOKEN_PATTERN = r"[A-Za-z0-9_+#./-]+|[\x{4e00}-\x{9fff}]"
CJK_PATTERN = r"[\x{4e00}-\x{9fff}]"
REQUIREMENT_YEARS_PATTERN = r"(?U)([0-9]+)\s*年"
# Full-width digits stand for plain ones.
WIDE_DIGITS, PLAIN_DIGITS = "０１２３４５６７８９", "0123456789"
REQUIREMENT_SKILL_PATTERN = r"[A-Za-z][A-Za-z0-9+#./]{1,30}"
YEAR_PATTERN = r"(20[0-9]{2}|19[0-9]{2})"
ID_NUMBER_PATTERN = r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])"
PHONE_PATTERN = r"(1[3-9][0-9])[0-9]{4}([0-9]{4})"
# --- fixed values: characters that count as white space at the ends of a text ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
EMAIL_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_DOMAIN = r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# --- fixed values: standard skill tags ---
STANDARD_TAGS = [
    "Python", "Java", "Go", "C++", "Rust",
    "Machine Learning", "Deep Learning", "NLP", "Computer Vision",
    "Product Management", "Agile", "Scrum", "Sales", "Marketing", "SaaS",
    "UI/UX Design", "Graphic Design", "SQL",
]

# --- fixed values: skill alias -> standard tag, in lookup order ---
SKILL_ALIASES = [
    ("py", "Python"), ("python3", "Python"), ("django", "Python"), ("flask", "Python"),
    ("fastapi", "Python"), ("pandas", "Python"), ("numpy", "Python"),
    ("java", "Java"), ("spring", "Java"), ("springboot", "Java"), ("j2ee", "Java"),
    ("golang", "Go"), ("go", "Go"),
    ("cpp", "C++"), ("c/c++", "C++"), ("c plus plus", "C++"),
    ("rust", "Rust"),
    ("ml", "Machine Learning"), ("machinelearning", "Machine Learning"), ("机器学习", "Machine Learning"),
    ("dl", "Deep Learning"), ("deeplearning", "Deep Learning"), ("深度学习", "Deep Learning"),
    ("nlp", "NLP"), ("自然语言处理", "NLP"),
    ("cv", "Computer Vision"), ("computervision", "Computer Vision"), ("计算机视觉", "Computer Vision"),
    ("pm", "Product Management"), ("productmanager", "Product Management"), ("产品经理", "Product Management"),
    ("agile", "Agile"), ("敏捷", "Agile"),
    ("scrum", "Scrum"),
    ("sales", "Sales"), ("销售", "Sales"),
    ("marketing", "Marketing"), ("市场营销", "Marketing"),
    ("saas", "SaaS"),
    ("ui", "UI/UX Design"), ("ux", "UI/UX Design"), ("ui/ux", "UI/UX Design"), ("uiux", "UI/UX Design"),
    ("ui设计", "UI/UX Design"),
    ("graphic design", "Graphic Design"), ("平面设计", "Graphic Design"),
    ("sql", "SQL"), ("mysql", "SQL"), ("postgresql", "SQL"),
]

# --- fixed values: panel of experts and arbitration weight by job category ---
PANEL_WEIGHTS = {
    "tech": {"interviewer": 0.35, "skill_evaluator": 0.35, "culture_fit": 0.15, "stability_analyzer": 0.15},
    "management": {"interviewer": 0.35, "leadership": 0.35, "culture_fit": 0.15, "stability_analyzer": 0.15},
    "design": {
        "interviewer": 0.30, "skill_evaluator": 0.25, "visual_evaluator": 0.15,
        "culture_fit": 0.15, "stability_analyzer": 0.15,
    },
    "general": {"interviewer": 0.50, "culture_fit": 0.30, "stability_analyzer": 0.20},
}
DEFAULT_CATEGORY = "general"
RULE_BASED_EXPERT = "stability_analyzer"
ADVOCATE = "devils_advocate"

# --- fixed values: enumerations ---
CATEGORIES = ["tech", "management", "design", "general"]
STANCES = ["maintain", "revise"]
REPLY_INTENTS = ["accept", "propose_new_time", "decline", "other"]
FEEDBACK_KINDS = ["suitable", "not_suitable", "pending"]
TASK_STATUSES = ["pending", "running", "succeeded", "failed"]

# --- fixed values: job-level settings that may be overridden, with their type ---
OVERRIDE_TYPES = {
    "rag_top_k": "int",
    "rerank_threshold": "double",
    "rerank_threshold_cosine": "double",
    "rerank_mode": "string",
    "rerank_pairs_factor": "int",
    "rerank_doc_chars": "int",
}
OVERRIDE_KEYS_ACCEPTED = [
    "rag_top_k", "rerank_threshold", "rerank_threshold_cosine", "rerank_mode",
    "rerank_pairs_factor", "rerank_doc_chars", "chunk_size", "enable_hyde",
]

# --- fixed values: histogram bucket edges in seconds ---
STAGE_EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 60.0]
SERVICE_EDGES = [
    0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0,
    13.0, 21.0, 34.0, 60.0, 120.0, 300.0, 600.0,
]

# --- fixed values: accepted resume file types and their leading bytes (hex) ---
FILE_SIGNATURES = [("pdf", "25504446"), ("png", "89504E47"), ("jpg", "FFD8FF"), ("jpeg", "FFD8FF")]

# --- fixed values: texts written into results ---
CLIP_MARKER = "\n...（中间省略）...\n"
UNTITLED_JOB = "未命名岗位"
INVITATION_SUBJECT = "面试邀请："
REASON_SKILLS = "技能匹配："
REASON_EVIDENCE = "原文证据："
NO_HISTORY_EVIDENCE = "无工作经历信息，默认中性分"
