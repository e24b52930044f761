"""Patterns, word lists and constants that results depend on."""

# Tokens, ranking and recall.
TOKEN_RUN = "[一-鿿]+|[a-z0-9]+"
BM25_K1, BM25_B, TERM_BOOST, TOP_K = 1.5, 0.75, 2.0, 10
TONES = ["紧张", "轻松", "悲伤", "热血", "爽", "甜", "温馨", "恐怖", "压抑", "其他"]
THEMES = ["爱情", "亲情", "友情", "权力", "金钱", "成长", "复仇", "悬念", "搞笑", "热血", "日常", "其他"]
RESOLVE_THRESHOLD, EVIDENCE_CHARS = 0.6, 120

# Chapter headings and numerals.
HEADING = r"^[ \t　]*第[ \t　]*([0-9零一二两三四五六七八九十百千]+)[ \t　]*([章回节])([ \t　]*)(.*?)[ \t　]*$"
HEADING_CHARS, UNSEPARATED_CHARS = 30, 12
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}

# Sentences and chapter measures.
SENTENCE_UNIT = "(?:“[^”]*+(?:”|\\z)|‘[^’]*+(?:’|\\z)|\"[^\"]*+(?:\"|\\z)|'[^']*+(?:'|\\z)|[^。！？!?…“‘\"']++)"
SENTENCE = f"{SENTENCE_UNIT}*+[。！？!?…]|{SENTENCE_UNIT}++"
DIALOGUE = "[“\"'‘][^”\"'’]{0,200}[”\"'’]"
TRIGGERS = {
    "施压动词": "威胁|逼迫|逼着|强迫|勒令|警告道|喝道|怒斥|责令|限期",
    "剥夺·损失": "剥夺|没收|收回|作废|清零|取消资格|断了|失去|赔光|一无所有",
    "冲突升级": "动手|出手|一拳|翻脸|爆发|摊牌|撕破脸|开战|宣战|反目",
    "轻视·打脸前置": "冷笑|不屑|嘲讽|讥讽|嗤笑|看不起|就凭你|也配",
    "质询逼问": "质问|审问|逼问|追问|拷问|为什么|凭什么|怎么回事",
    "陷害·背叛": "陷害|栽赃|背叛|出卖|反水|下毒|暗算|设局|算计",
    "救援·解围": "赶到|出手相救|挡在|护住|解围|救下|拦下|撑住",
    "规则惩罚": "违规|触犯|惩罚|处罚|代价|反噬|禁止|规则|条例|判定",
    "能力释放": "觉醒|解锁|突破|进阶|晋升|激活|爆发|开挂|领悟",
    "悬念提问": "难道|莫非|究竟|到底|是谁|怎么会|忽然意识到|不对劲",
}
SUSPENSE = ["悬念提问", "质询逼问"]
SHORT_SENTENCE, LONG_SENTENCE, WINDOW_CHARS, ANCHORS = 12, 45, 200, 50

# Gates.
BAND_LOW, BAND_HIGH, TARGET_CHARS = 0.85, 1.15, 2600
REPEAT_CHARS, REPEAT_COUNT, ADJACENT_CHARS = 12, 3, 8
RECENT, GRAM, JACCARD_MAX, CONTAINMENT_REPORT = 20, 5, 0.30, 0.45
ENGINEERING_WORDS = ["细纲", "情节点", "卷纲", "功能标签", "目标情绪", "字数目标", "章首钩子", "章尾钩子", "任务描述"]
SELF_REFERENCE = ["作为(?:一个)?(?:AI|人工智能|语言模型)", "(?:我|本模型)(?:无法|不能)(?:继续|生成|创作|协助)", "(?:很抱歉|抱歉)[，,](?:我|但)"]
PLACEHOLDERS = [r"\{\{?[^}]{1,30}\}\}?", "【(?:待填|占位|TODO|待补)", "(?:此处省略|以下省略|略去)[^。]{0,10}(?:字|内容)"]
CLOSING = "。！？…”』」）)!?.~—:：\"'】〕〉》"
PLACEHOLDER_BANNER = "【Fake 占位正文：由离线规则生成，仅用于跑通流程，不是可用的小说内容，请替换】"

# Fingerprint rules and drift.
NOT_X_BUT_Y = r"不是[^。！？；\n]{1,30}?[，、]?(?:而是|是)"
SIMILE_CHAPTER = "像|仿佛|宛如|如同|似的|一般般|一般(?=[，。！？])"
DE_RUN = r"的(?:[^。！？；，、\n的]{0,4}的){2,}"
SCENE_START = (
    r"^\s*(?:与此同时|片刻后|半晌后|不知过了多久|转瞬|须臾|次日|第二天|三天后|翌日|当晚|夜幕|凌晨|清晨|黄昏|正午|傍晚|另一边|另一头|那一边|"
    "这边|这边厢|另一处|门外的|屋内|屋外|殿内|殿外|车上|车外|楼下|楼上|街角|巷口|院中|院外|城门口|大殿上|山坡上|山脚下|河边|林中|此处|那边|远处|近处)"
)
TRANSITION = "与此同时|另一边|另一头|片刻后|不知过了多久|次日|翌日|第二天"
FINGERPRINT_LIMITS = {"not_x_but_y": 3.0, "em_dash": 5.0, "period_per_paragraph": 0.15, "simile_density": 10.0, "de_repeat": 2.0, "scene_rotation": 5.0, "cjk_chars": 2000.0, "single_quote": 0.0}
PERIODS_PARAGRAPH, DENSE_SIMILES, MAX_VIOLATIONS = 3, 0.05, 1
DRIFT_WINDOW, DRIFT_RATIO = 5, 2.0
DRIFT_P95 = {"em_dash": 9.0, "period_per_paragraph": 0.143, "simile_density": 12.0}

# Style measures.
CJK_WIDE, CJK_STYLE, CJK = "[㐀-䶿一-鿿豈-﫿]", "[㐀-䶿一-鿿]", "[一-鿿]"
STYLE_SENTENCE = r"[^。！？\n]+[。！？]?"
QUOTED, CLAUSE_END = "[「“]([^」”]*)[」”]", r"[，、；：。！？\n]"
DENSITIES = {
    "比喻密度": "像|仿佛|宛如|如同|似的|好比|像是",
    "破折号密度": "——|—|―",
    "心理词密度": "觉得|感到|意识到|明白|知道|想起|记得|心里|心中|心底|内心|情绪|心情|念头",
    "显式情绪密度": "害怕|怕|生气|恼|怒|高兴|开心|难过|悲|伤心|紧张|慌|急|委屈|尴尬|羞愧|愧疚|兴奋|激动|失望|绝望|不甘|烦躁|厌烦|无奈|踏实|安心|发怵|心虚|得意|痛快",
    "身体外化密度": "胸口|喉咙|嗓子|后颈|后背|胃里|太阳穴|指尖|指节|手心|掌心|脊背|头皮|鼻腔|眼眶|牙关|下颌|肋骨|膝盖|肩胛",
    "叹号密度": "[！!]",
    "语气词密度": "[啊吧呢嘛呗哦呀哈嘿唉哎嘶嘞]",
    "省略号密度": r"……|\.\.\.",
    "数字读数密度": r"[零一二三四五六七八九十百千万亿]{2,}|[0-9]+(?:\.[0-9]+)?",
    "解释腔密度": "是因为|之所以|原来|这意味着|也就是说|换句话说|仿佛预示|注定",
}
DIALOGUE_DENSITIES = {
    "对白语气词密度": DENSITIES["语气词密度"],
    "对白解释腔密度": "是因为|之所以|原来|这意味着|也就是说|换句话说|仿佛预示|注定|其实|所以|因为",
    "对白客气语密度": "请|麻烦|谢谢|不好意思|对不起|劳驾",
    "对白称呼密度": "哥|姐|叔|姨|爷|奶|老板|老大|老师|师父|师兄|师弟|队长|教练",
    "对白第二人称密度": "你|您|你们",
}
DIALOGUE_TAIL, DIALOGUE_SAY = "[。！？…—」”]$", "说|问|道|答|喊|叫|嚷|嘟囔|低声|开口"
PARAGRAPH_MARKS = "。！？…”」』）)!?~～"
PARAGRAPH_END = f"[{PARAGRAPH_MARKS}]$"
SENTENCE_MARKS, CLAUSE_MARKS = r"。！？\n", r"，、；：。！？\n"
STYLE_CHARS, PARAGRAPH_CHARS = 300, 400
DIALOGUE_MINIMA = {"paragraphs": 8, "quotes": 4, "chars": 500, "quoted": 100}
#: metric: direction, bound, limit, prompt.
STYLE_RULES = {
    "破折号密度": ("hi", "p95", 2.8523, 0.6223),
    "身体外化密度": ("hi", "p95", 1.2428, 0.5118),
    "分句均字": ("lo", "p10", 7.5508, 8.7587),
    "单句段占比": ("lo", "p5", 0.5806, 0.9059),
    "段均句数": ("hi", "p95", 1.6235, 1.2131),
    "段p90字": ("lo", "p10", 35.0, 48.0),
}
DIALOGUE_RULES = {
    "对白破折号占比": ("hi", "p95", 0.0769, 0.0385),
    "对白条数每千字": ("hi", "p95", 25.2226, 17.7994),
    "对白第二人称密度": ("hi", "p95", 45.4545, 28.4322),
    "对白句均字": ("lo", "p1", 6.5263, 17.6875),
}
#: The measured percentiles (1, 5, 10, 25, 50, 75, 90, 95, 99) of the metrics that have a rule.
PERCENTS = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0]
PERCENTILES = {
    "破折号密度": [0.0, 0.0, 0.0, 0.0, 0.0, 0.6223, 1.7384, 2.8523, 5.531],
    "身体外化密度": [0.0, 0.0, 0.0, 0.0, 0.0, 0.5118, 0.932, 1.2428, 2.287],
    "分句均字": [6.8602, 7.28, 7.5508, 8.0645, 8.7587, 9.5652, 10.5629, 11.3491, 12.7448],
    "单句段占比": [0.3875, 0.5806, 0.6825, 0.8197, 0.9059, 0.9593, 0.9865, 1.0, 1.0],
    "段均句数": [0.9474, 0.978, 0.9922, 1.026, 1.0926, 1.2131, 1.434, 1.6235, 2.0],
    "段p90字": [27.0, 32.0, 35.0, 41.0, 48.0, 60.0, 74.0, 84.0, 108.0],
    "对白破折号占比": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0385, 0.0769, 0.1818],
    "对白条数每千字": [3.2979, 5.3248, 6.7323, 9.6096, 13.4739, 17.7994, 22.1457, 25.2226, 31.6494],
    "对白第二人称密度": [0.0, 1.1952, 4.1322, 9.7826, 18.3486, 28.4322, 38.771, 45.4545, 58.4795],
    "对白句均字": [6.6111, 8.6471, 10.0909, 13.1538, 17.6875, 23.6087, 30.8444, 37.7391, 59.875],
}

# Knowledge base.
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP = 800, 1200, 80
SUFFIXES, FILE_BYTES, SCAN_CHARS, CHAPTER_LINES, ANALYSIS_TERMS = [".docx", ".md", ".txt"], 1024 * 1024, 512 * 1024, 8, 8
CHAPTER_LINE = r"^\s*#{0,6}\s*第[0-9零一二三四五六七八九十百千万两]+[章节回部卷]"
ANALYSIS_PATH = "拆|分析|报告|指南|教程|心得|笔记|研究|调研|扫榜|仿写|方法论|大纲|拆解|逐章|总结|决策|详案"
ANALYSIS_WORDS = "拆解|拆书|拆文|分析|爽点|钩子|伏笔|节奏|大纲|卖点|追读|毒点|期待感|详案|方法论|仿写|人设|金手指|题材|章尾|开篇"
BOOK_AUTHOR, FRONT_CHAPTERS, SINGLE_CHAPTER = r"(?i)^.+\s*-\s*.+\.txt$", r"前\s*40\s*章", "第[0-9零一二三四五六七八九十百千万两]+章"
SNIPPETS, SNIPPET_CHARS = 5, 400

# Rule summaries.
SUMMARY_SENTENCE = r"[^。！？!?…\n]+(?:[。！？!?…]+|$)"
#: The same pieces and, so that no run is read twice, those that a line's end cuts off (they end in a line feed).
SUMMARY_PIECE = r"[^。！？!?…\n]++(?:[。！？!?…]++|\n|\z)"
QUOTE_CHARS, GIST_CHARS, PLOT_POINTS = 20, 60, 40
HORROR = ["鬼", "尸", "血", "死", "悚", "魂"]
THEME_WORDS = {"亲情": ["父", "母", "家", "兄", "妹"], "复仇": ["仇", "杀"], "搞笑": ["笑", "逗"], "金钱": ["钱", "币", "财"], "成长": ["修", "级", "练"], "悬念": ["谁", "谜", "为何"]}
USABLE = ["auto-accepted", "human-confirmed"]
READ_ONLY_TURNS, STUCK_PATTERNS = 4, 2
TEMPERATURES = (0.3, 1.0)
NOISE_LINE = r"^[=\-_*#~\s]{4,}$"

# Paths that messages must not show.
URL_PATH = r"\b(https?://[^/\s:\"'<>]+)[^\s\"'<>]*"
WINDOWS_PATH = r"(?<![A-Za-z])[A-Za-z]:[\\/]+(?:[^\\/\s\"'<>|,*?:]+[\\/]+)*[^\\/\s\"'<>|,*?:]*"
POSIX_PATH = r"/(?:Users|home|root|private|var|opt|tmp)/[^\s\"'<>|,;]*"
HIDDEN_PATH = "<路径>"
QUOTE = r"""[“"'‘]([^”"'’\n]*)[”"'’]?"""

# Quotes, order lists, sources of the baselines.
MAX_QUOTE_CHARS, LOOSE_CHARS, PLACEHOLDER = 30, 4, "（待确认）"
LOOSE_MARKS = "，。！？!?…、：；“”\"'‘’（）()《》〈〉,.-—·"
ORDERS_SHOWN = 12
SEMANTIC_CHAPTERS = 40
STAMP = r"^\d{8}-\d{6}-\d{6}$"
STRUCTURE_FIELDS = ["avg_sentence_chars", "avg_dialogue_ratio", "per_thousand_conflicts", "median_sentence_chars", "short_sentence_ratio", "hook_recovery_median", "hook_recovery_longest", "hook_open_count"]
BASELINES = {
    "style": {"version": "style-v1", "books": 67, "chapters": 5829, "holdout_books": 20, "holdout_chapters": 1640, "ai_chapters": None},
    "dialogue": {"version": "style-dlg-v1", "books": 81, "chapters": 31889, "holdout_books": 18, "holdout_chapters": 4654, "ai_chapters": 11},
}

# JSON in texts, chapter transactions.
JSON_FENCE = r"^```(?:json)?\s*|\s*```$"
MAX_REPAIRS, STYLE_FINDINGS, DEGRADED_IN_A_ROW = 2, 2, 3

# Messages of this engine.
WRITER_FAILED, GATE_REJECTED, BUDGET_SPENT, COMMIT_REFUSED = "writer failed", "gate rejected", "repairs used up", "commit refused"

# Rendered deconstructions (headings, labels of the table: name, digits, factor, before, after), indexed parts, tools.
AUTHOR_TITLE, KB_TITLE, MEASURED_TITLE, KB_MEASURED_TITLE = "# 拆书测量稿：", "# 测量型写作手法备忘：", "## 客观测量", "## 可直接对标的客观数值"
DENSITY_HEAD = "## 冲突密度的章级分布\n\n| 章 | 每千字疑似冲突点 |\n|---:|---:|"
LEDGER_HEAD = "## 钩子的回收节奏\n\n| 埋钩章 | 回收章 | 间隔（章） |\n|---:|---:|---:|"
TECHNIQUES_HEAD, NO_TECHNIQUES, UNRESOLVED, NO_SPAN = "## 迁移到自己稿子上的做法", "- （语义层未接入：需先用真实模型跑 analyze，或你自己在这里补）", "未回收", "—"
TABLE_HEAD = "| 指标 | 数值 |\n|---|---:|"
TABLE_ROWS = [
    ("total_chars", "总字数（去空白）", 0, 1, "", ""),
    ("avg_chapter_chars", "章均字数", 0, 1, "", ""),
    ("avg_sentence_chars", "平均句长", 2, 1, "", ""),
    ("median_sentence_chars", "句长中位数", 1, 1, "", ""),
    ("short_sentence_ratio", "短句占比（≤12 字）", 2, 100, "", "%"),
    ("long_sentence_ratio", "长句占比（>45 字）", 2, 100, "", "%"),
    ("avg_dialogue_ratio", "对话句占比", 2, 100, "", "%"),
    ("per_thousand_conflicts", "疑似冲突点密度", 2, 1, "每千字 ", " 处"),
]
ORDER_ROWS = {"quiet": "节奏空窗候选章", "opening_hook_signal": "开篇有悬念信号", "closing_hook_signal": "章尾有悬念信号"}
LEDGER_ROWS = [("median_span", "钩子回收间隔中位数", " 章"), ("longest_span", "最长吊钩间隔", " 章"), ("open_hooks", "读到最后一章仍未回收", " 条")]
PARTS = {
    "positioning": ("positioning", "positioning", ["genre", "audience", "core_premise", "selling_points", "tone_target"]),
    "volume": ("volume", "volume", ["volume_title", "volume_goal", "main_conflict", "ending_hook"]),
    "chapters": ("outline-chapter-", "chapter_outline", ["title", "core_event", "opening_hook", "ending_hook"]),
    "protagonist": ("protagonist", "protagonist", ["name", "background", "personality", "desire", "flaw", "signature_ability"]),
    "golden_finger": ("golden-finger", "golden_finger", ["name", "form", "ability", "cost_limitation", "growth_path"]),
}
POSITIONING_TITLE, SUMMARY_DOC, SUMMARY_TYPE = "题材定位", "summary-chapter-", "chapter_summary"
TOOL_ARGUMENTS = {"get_outline": {"order": int}, "search_own_book": {"query": str}, "list_open_foreshadows": {}, "search_methodology": {"query": str}}
METHODOLOGY_HITS, OWN_BOOK_HITS, ERROR_CHARS = 3, 5, 200
NO_OUTLINE, OUTLINE, NO_HOOKS, OPEN_HOOK, NO_HITS = "没有第 %d 章细纲（当前细纲共 %d 章）。", "第%d章《%s》｜核心事件：%s｜开篇钩：%s｜章尾钩：%s", "当前没有待回收伏笔。", "- 第%d章埋：%s", "本书暂无相关内容。"
NO_METHOD, METHOD_HIT, BOOK_HIT = "知识库无命中（可能尚未建库，或没有相关资料）。", "- 来源 %s ：%s", "- [%s] %s：%s"
