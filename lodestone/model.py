"""Record schemas and the fixed values that results depend on."""

from __future__ import annotations

# --------------------------------------------------------------------------- schemas (Spark DDL)

DOCUMENTS = "doc_id string, source_type string, title string, content string"
QUESTIONS = (
    "question_id string, question_type string, source_types array<string>, question string, "
    "expected_doc_ids array<string>, gold_answer string, answer_facts array<string>, "
    "required_evidence_groups array<array<string>>"
)
PARENTS = (
    "parent_chunk_id string, parent_doc_id string, source_type string, doc_semantic_type string, "
    "title string, parent_chunk_index int, section_heading string, text string, text_chars int, "
    "is_gold_parent boolean"
)
CHILDREN = (
    "chunk_id string, parent_chunk_id string, parent_doc_id string, source_type string, "
    "doc_semantic_type string, title string, parent_chunk_index int, child_chunk_index int, "
    "section_heading string, text string, text_chars int, parent_text_chars int, "
    "is_gold_parent boolean"
)
ENTITIES = (
    "entity_id string, name string, normalized_name string, entity_type string, "
    "description string, source_chunk_ids array<string>, aliases array<string>"
)
RELATIONS = (
    "relation_id string, src_entity_id string, tgt_entity_id string, relation_type string, "
    "description string, keywords array<string>, weight double, source_chunk_ids array<string>"
)
FILTER_DECISION = (
    "mode string, source_types array<string>, doc_semantic_types array<string>, "
    "title_keywords array<string>, section_keywords array<string>, confidence double, reason string"
)

# --------------------------------------------------------------------------- fixed values: corpus

ALLOWED_SOURCES = [
    "slack", "gmail", "linear", "google_drive", "hubspot", "fireflies", "github", "jira", "confluence",
]
SEMANTIC_TYPES = [
    "account_notes", "chat_thread", "code_change", "email_thread", "faq", "generic_doc",
    "issue_ticket", "meeting_notes", "playbook", "policy_rule", "technical_doc",
]
SOURCE_TO_SEMANTIC_TYPE = {
    "fireflies": "meeting_notes",
    "slack": "chat_thread",
    "gmail": "email_thread",
    "hubspot": "account_notes",
    "jira": "issue_ticket",
    "linear": "issue_ticket",
}

# Words that decide a document's semantic type.  (type, whole words, free text)
CODE_CHANGE_WORDS = "pr|pull request|diff|commit|merge|lgtm"
ISSUE_WORDS = "issue|bug|incident|ticket|failure|error|regression"
DOCUMENT_TYPE_WORDS = [
    ("policy_rule", "policy|handbook|rule|compliance|security-gating|must complete|must follow", "守则|制度|规范"),
    ("playbook", "playbook|runbook|checklist|procedure|process|workflow|onboarding|guide|how to|when to use", None),
    ("faq", "faq|frequently asked questions", None),
    ("technical_doc", "architecture|design|rfc|technical spec|specification|adr|proposal", None),
    ("meeting_notes", "meeting notes|meeting header|attendees|agenda|action items", None),
]
# Labels that count only when a colon and then white space or the end follows.
DOCUMENT_TYPE_LABELS = {"faq": "q|question", "meeting_notes": "decision"}

SECTION_LINE = r"^(#{1,6}\s+.+|[A-Za-z][A-Za-z0-9 _/-]{1,80}:|Purpose|Scope|Summary|Architecture notes.*)$"
SECTION_MAX_CHARS = 120

# Separators, tried in this order; the empty one cuts at a fixed size.
STRUCTURE_SEPARATORS = [
    "\n## ", "\n### ", "\n#### ", "\nsummary:", "\ntranscript:", "\ndescription:",
    "\nreview_comments:", "\nnotes:", "\nPurpose", "\nScope", "\nFrom:", "\nSubject:",
    "\n\n", "\n", ". ", "; ", ", ", " ", "",
]
UPLOAD_SEPARATORS = ["\n\n", "\n", "。", "！", "？", "!", "?", " ", ""]

# Lines that open a semantic unit, per document type.
UNIT_OPENERS = {
    "policy_rule": r"^(?:\d+[.)]|[A-Za-z][.)]|[-*])\s+\S|^(?:Rule|Policy|Requirement)\s*\d*\s*:",
    "meeting_notes": r"^(?:Decision|Decisions|Action item|Action items|Actions|Notes|Agenda|Attendees)\s*:",
    "playbook": r"^(?:\d+[.)]|[-*])\s+\S|^(?:Step|Checklist|Procedure)\s*\d*\s*:",
    "faq": r"^(?:Q|Question|A|Answer)\s*:",
    "technical_doc": r"^(?:#{1,6}\s+\S|(?:Overview|Design|Architecture|Rationale|Implementation|Risks)\s*:)",
    "issue_ticket": r"^(?:Description|Impact|Root cause|Resolution|Acceptance criteria|Steps to reproduce)\s*:",
}

# Chunking profiles (name, parent size, parent overlap, child size, child overlap, mode).
FIXED_PROFILES = [
    ("fixed_baseline", 3000, 300, 700, 100, "recursive"),
    ("fixed_smaller_child", 3000, 300, 500, 80, "recursive"),
    ("fixed_larger_child", 3000, 300, 900, 120, "recursive"),
    ("fixed_larger_parent", 4000, 400, 700, 100, "recursive"),
]
SEMANTIC_PROFILES = [
    ("semantic_baseline_threshold", 3000, 300, 700, 100, "semantic"),
    ("semantic_smaller_child", 3000, 300, 500, 80, "semantic"),
    ("semantic_larger_child", 3000, 300, 900, 120, "semantic"),
]

# --------------------------------------------------------------------------- fixed values: search

CHILD_TOKEN = r"[a-z0-9_.$%/-]+"
PARENT_TOKEN = r"[a-z0-9_./#-]+"
CJK_CHARACTER = r"[一-鿿]"
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
SOFT_BOOST = 0.15
COVERAGE_WEIGHT = 0.25
FIELD_BOOSTS = {"child_text": 2.0, "parent_text": 1.0, "title": 2.0, "section_heading": 1.0}
KEYWORD_FIELDS = ["source_type", "doc_semantic_type"]

# Question types.
DECOMPOSED_TYPES = ["multi_hop", "comparison"]
RERANKED_TYPES = [
    "semantic", "semantic_query", "multi_hop", "comparison", "intra_document_reasoning",
    "project_related", "constrained", "conflicting_info", "completeness", "high_level",
]
BROAD_INTENTS = ["multi_hop", "comparison", "completeness", "conflicting_info"]
NARROW_INTENTS = ["constrained", "project_related"]
PASS_THROUGH_TASKS = [
    "fact_lookup", "semantic_query", "multi_hop", "comparison", "procedure", "constrained", "follow_up",
]
LOW_CONFIDENCE = 0.65

# What each retrieval method switches on.
# (method, vector, bm25, graph, source boost, rerank: none/all/complex, decompose)
METHODS = [
    ("chroma_only", True, False, False, False, "none", False),
    ("bm25_only", False, True, False, False, "none", False),
    ("chroma_bm25_rrf", True, True, False, False, "none", False),
    ("chroma_bm25_rrf_source_boost", True, True, False, True, "none", False),
    ("chroma_bm25_rrf_reranker", True, True, False, False, "all", False),
    ("chroma_bm25_graph_rrf", True, True, True, False, "none", False),
    ("chroma_bm25_graph_rrf_reranker", True, True, True, False, "all", False),
    ("strategy_matrix", True, True, False, True, "complex", False),
    ("strategy_matrix_decompose", True, True, False, True, "complex", True),
    ("strategy_matrix_graph", True, True, True, True, "complex", False),
    ("strategy_matrix_decompose_graph", True, True, True, True, "complex", True),
]
METHOD_ALIASES = {
    "hybrid_bm25_rrf": "chroma_bm25_rrf",
    "hybrid_bm25_rrf_reranker": "chroma_bm25_rrf_reranker",
}

# Strategy per intent.
# (intent, strategy name, search depth per channel and after fusion, final, rerank, rewrite, decompose)
STRATEGIES = [
    ("fact_lookup", "dense_bm25_rrf", 40, 5, False, False, False),
    ("semantic_query", "dense_bm25_rrf_reranker", 40, 5, True, False, False),
    ("multi_hop", "dense_bm25_rrf_reranker_decompose", 80, 10, True, False, True),
    ("comparison", "dense_bm25_rrf_reranker_decompose", 80, 10, True, False, True),
    ("procedure", "dense_bm25_rrf", 60, 8, False, False, False),
    ("constrained", "dense_bm25_rrf_reranker", 60, 8, True, False, False),
    ("follow_up", "history_rewrite_dense_bm25_rrf", 40, 5, False, True, False),
]
DEFAULT_STRATEGY = ("conservative_hybrid", 40, 5, False, False, False)
LOW_CONFIDENCE_STRATEGY = "low_confidence_hybrid_reranker"

# Words that name a source or a document type in a query.  (name, whole words, free text)
SOURCE_MENTIONS = [
    ("slack", "slack", "聊天|群里|频道"),
    ("gmail", "gmail|email", "邮件|邮箱"),
    ("linear", "linear", None),
    ("google_drive", "google drive", "drive 文档|共享文档"),
    ("hubspot", "hubspot|account notes", "客户记录"),
    ("fireflies", "fireflies|meeting transcript", "会议转录"),
    ("github", "github|pull request|pr|commit|repo", "代码"),
    ("jira", "jira|ticket|issue|bug", "缺陷"),
    ("confluence", "confluence|wiki", "知识库页面"),
]
TYPE_MENTIONS = [
    ("policy_rule", "policy|rule|sop|pto", "规定|政策|制度|合规|报销"),
    ("playbook", "playbook|runbook", "操作手册|应急手册|流程手册"),
    ("meeting_notes", "meeting notes|meeting", "会议记录|纪要"),
    ("email_thread", "email thread", "邮件线程|邮件"),
    ("chat_thread", "chat thread|slack thread", "聊天记录|讨论串"),
    ("issue_ticket", "ticket|issue|bug|incident", "工单|缺陷|事故"),
    ("code_change", "pull request|pr|commit|diff|repo", "代码变更"),
    ("account_notes", "account notes|crm", "客户记录|客户备注"),
    ("faq", "faq|frequently asked questions", "常见问题"),
    ("technical_doc", "rfc|adr|technical spec|architecture|design doc", "架构|技术方案"),
]

# Markers of the external-search rules, matched as lower-case substrings.
# A caller adds the name of its own product to COMPANY_MARKERS through a parameter.
COMPANY_MARKERS = [
    "我们公司", "我司", "本公司", "公司内部", "公司知识库", "正式制度", "our company", "my company",
    "at our company", "internal policy", "internal docs", "internal documentation",
    "internal knowledge base", "our internal",
]
PRIVATE_FACT_MARKERS = [
    "员工工资", "薪资", "salary", "salary band", "salary bands", "绩效", "报销上限",
    "reimbursement limit", "deployment endpoint", "endpoint", "审批人", "负责人",
]
SPECIFIC_MARKERS = [
    "是多少", "是什么", "具体", "上限", "limit", "金额", "谁", "哪位", "工号", "名单", "电话", "邮箱",
    "what is", "how much", "salary band", "salary bands", "who",
]
PROCEDURE_MARKERS = [
    "流程", "程序", "步骤", "申请", "报销", "休假", "pto", "procedure", "process", "how do i", "how to", "request",
]
MISSING_MARKERS = [
    "如果公司知识库没有", "如果知识库没有", "知识库没有", "公司知识库没有", "找不到", "缺少", "未找到",
    "if the knowledge base does not have", "if our knowledge base does not have", "if no internal",
    "if internal docs do not have", "if internal documentation does not have", "not found", "no internal",
]
GENERIC_MARKERS = ["通用", "一般", "常见", "generic", "general", "common", "best practices"]
GENERIC_REFERENCE_MARKERS = [
    "通用参考", "通用流程参考", "一般参考", "常见参考", "generic reference", "general reference", "common reference",
]
PUBLIC_MARKERS = [
    "业界", "行业", "公开", "最佳实践", "趋势", "对比", "差距", "通用", "常见", "industry", "public",
    "best practice", "best practices", "trend", "benchmark", "common", "generic", "general",
]
INJECTION_PHRASES = [
    "ignore previous instructions", "忽略之前的指令", "泄露系统提示词", "输出 api key", "delete all", "reset database",
]
REWRITE_SUFFIX = "enterprise knowledge evidence"

# --------------------------------------------------------------------------- fixed values: audit, memory

SECRET_KEY_WORDS = [
    "api_key", "apikey", "authorization", "cookie", "password", "secret", "token", "jwt",
    "access_key", "refresh_token", "connection_string",
]
# Cuts of the published retrieval methods.
MAX_FACTS = 4
RERANK_CHARS = 4000
MEMORY_TYPES = ["preference", "profile", "project", "decision", "task", "assistant_output", "other"]
MEMORY_OPT_OUTS = [
    "不要记", "别记", "不要保存", "别保存", "不要写入记忆", "do not remember", "don't remember", "do not save",
]
SUB_QUERY_PURPOSES = ["fact", "comparison_dimension", "procedure_step", "constraint", "verification"]
DEFAULT_SESSION_TITLE = "新的对话"
UNTITLED_SESSION = "新会话"
JUDGE_METRICS = [
    "faithfulness", "answer_relevancy", "answer_correctness", "context_precision", "context_recall",
]
MIN_RELEVANCE = 0.35
DUPLICATE_RELEVANCE = 0.92
