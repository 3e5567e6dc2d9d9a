"""Word lists and constants of the rule-based functions. All are fixed values: results depend on them as they stand."""

# Key words of document types, in the order that settles ties.
DOC_TYPES = {
    "concept": ["什么是", "定义", "介绍", "概念", "解释", "概述", "简介", "原理", "说明", "基础", "入门", "指南"],
    "tutorial": ["教程", "步骤", "如何", "怎么", "方法", "手把手", "实践", "实现", "代码", "示例", "例子", "演示", "练习"],
    "technical": ["技术", "架构", "设计", "实现", "细节", "分析", "对比", "比较", "优化", "改进", "性能", "瓶颈", "问题"],
    "reference": ["参考", "手册", "API", "文档", "参数", "配置", "选项", "命令", "用法", "示例"],
}

# Tags of documents.
TAGS = [
    "RAG", "检索增强生成", "LLM", "大语言模型", "向量", "嵌入", "索引", "分块", "chunking", "PostgreSQL", "pgvector", "LlamaIndex", "混合检索", "稠密", "稀疏", "BM25",
    "MQE", "多查询扩展", "HyDE", "假设文档", "Parent-Child", "分层索引", "智能路由", "流式输出", "Docker", "Git", "Python", "测试", "性能优化",
]

# Patterns of document types in questions.
QUERY_DOC_TYPES = {
    "technical": ["技术", "技术文档", "技术方案", "架构", "设计", "实现细节", "分析", "对比", "技术对比", "性能", "优化"],
    "tutorial": ["教程", "步骤", "如何", "怎么", "方法", "手把手", "实践", "示例", "例子", "演示", "练习", "实现"],
    "concept": ["概念", "什么是", "定义", "介绍", "解释", "概述", "简介", "原理", "说明", "基础", "入门", "指南"],
    "reference": ["参考", "手册", "API", "文档", "参数", "配置", "命令", "用法"],
}

# Patterns of tags in questions.
QUERY_TAGS = {
    "RAG": ["rag", "检索增强生成", "检索增强"],
    "LLM": ["llm", "大语言模型", "大模型", "语言模型"],
    "chunking": ["分块", "chunking", "分词", "文本分割", "节点切分"],
    "向量": ["向量", "嵌入", "embedding", "向量检索", "相似度"],
    "索引": ["索引", "index", "索引构建", "建索引"],
    "PostgreSQL": ["postgresql", "pgvector", "postgres", "pg"],
    "LlamaIndex": ["llamaindex", "llama index"],
    "混合检索": ["混合检索", "hybrid", "稠密检索", "稀疏检索", "bm25"],
    "MQE": ["mqe", "多查询扩展", "查询扩展"],
    "HyDE": ["hyde", "假设文档", "假设文档嵌入"],
    "Parent-Child": ["parent-child", "分层索引", "父子节点", "层次索引"],
    "智能路由": ["智能路由", "路由", "快速通道", "查询分类"],
    "Docker": ["docker", "容器化", "容器"],
    "流式": ["流式", "streaming", "流式输出", "sse"],
}

# Words that send a question down the full or the fast channel.
COMPLEX_WORDS = [
    "为什么", "如何", "怎么", "怎样", "请说明", "请解释", "详细", "比较", "区别", "关系", "联系", "差异", "原理", "机制", "流程", "步骤", "优缺点", "优势",
    "劣势", "影响", "作用", "应用场景", "最佳实践", "举例", "示例", "对比", "分析", "总结", "什么", "哪些", "哪几种", "是什么", "有哪些",
]
REFERRAL_WORDS = ["它", "它们", "这个", "那个", "这些", "那些", "这种", "那种", "上述", "以上", "该"]
GREETINGS = ["你好", "您好", "hi", "hello", "hey", "在吗", "在不在", "你好吗"]

# Indicators of the four routing features.
COMPLEXITY = ["首先", "然后", "接着", "最后", "步骤", "规划", "方案", "系统", "拆解", "分步骤", "分步", "多步", "比较", "分析", "评估", "设计", "开发", "解决", "权衡", "取舍", "选择", "对比", "多种", "几种", "所有", "不同", "框架"]
EXTERNAL = ["搜索", "查询", "获取", "调用", "API", "查找", "价格", "查一下", "搜一下", "找一下", "汇率"]
ITERATION = ["优化", "润色", "改进", "审查", "验证", "检查", "迭代", "完善", "反思", "修复", "重写"]
STRUCTURE = ["列表", "表格", "JSON", "格式", "结构化", "步骤", "模板", "框架", "代码", "计划", "规划", "设计", "计算", "翻译", "调用", "API", "生成"]

# The ranges of the six paradigms (complexity 1 to 5, the others 0 to 1) and their priority.
PARADIGMS = [
    ("simple", (1, 2), (0, 0.3), (0, 0.2), (0, 0.2), 1),
    ("react", (1, 3), (0.2, 1.0), (0, 0.3), (0, 0.25), 3),
    ("reflection", (1, 3), (0, 0.3), (0.2, 1.0), (0, 0.4), 4),
    ("plan_and_solve", (2, 4), (0, 0.3), (0, 0.3), (0.2, 1.0), 3),
    ("function_call", (1, 1), (0, 1.0), (0, 0.2), (0.2, 0.4), 2),
    ("tree_of_thought", (2, 5), (0, 0.3), (0, 0.3), (0, 0.15), 4),
]
SOFT_MARGIN = 0.3
MATCH_THRESHOLD = 0.5

# Known technical words and the type of entity they are.
TECH_ENTITIES = {
    "python": "language", "java": "language", "javascript": "language", "golang": "language", "go": "language", "rust": "language", "c++": "language", "c#": "language", "ruby": "language",
    "ai": "concept", "人工智能": "concept", "ml": "concept", "机器学习": "concept", "深度学习": "concept", "nlp": "concept", "自然语言处理": "concept", "llm": "concept", "大模型": "concept",
    "tensorflow": "tool", "pytorch": "tool", "numpy": "tool", "pandas": "tool", "scikit-learn": "tool", "docker": "tool", "kubernetes": "tool", "git": "tool",
    "react": "technology", "vue": "technology", "angular": "technology", "flask": "technology", "django": "technology", "fastapi": "technology",
    "redis": "technology", "mysql": "technology", "postgresql": "technology", "mongodb": "technology", "elasticsearch": "technology",
}

# Technical words that raise a dialogue's importance.
TECH_WORDS = [
    "RAG", "LLM", "API", "SQL", "JSON", "YAML", "XML", "HTTP", "向量", "嵌入", "索引", "分块", "检索", "生成", "模型", "训练", "推理", "部署", "缓存", "并发", "异步", "同步", "线程", "进程",
    "数据库", "存储", "查询", "过滤", "排序", "聚合", "事务", "锁", "Python", "Docker", "Git", "算法", "数据结构", "协议", "加密", "认证", "授权", "中间件", "微服务", "容器", "编排", "监控",
    "日志", "测试", "调试", "优化", "重构", "设计模式", "架构",
]

# Document types and modalities by file extension.
DOC_TYPE_BY_EXTENSION = {
    ".txt": "text", ".log": "text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".docx": "word", ".doc": "word", ".xlsx": "excel", ".xls": "excel", ".csv": "data", ".pptx": "ppt", ".ppt": "ppt",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".bmp": "image", ".webp": "image", ".mp3": "audio", ".wav": "audio", ".flac": "audio", ".aac": "audio", ".m4a": "audio",
    ".mp4": "video", ".avi": "video", ".mov": "video", ".mkv": "video", ".py": "code", ".js": "code", ".ts": "code", ".java": "code", ".go": "code", ".c": "code", ".cpp": "code", ".rs": "code", ".sql": "code",
    ".json": "data", ".xml": "data", ".yaml": "data", ".yml": "data",
}
MODALITY_BY_EXTENSION = {
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".bmp": "image", ".webp": "image", ".mp4": "video", ".avi": "video", ".mov": "video", ".mkv": "video",
    ".mp3": "audio", ".wav": "audio", ".flac": "audio", ".aac": "audio", ".py": "code", ".js": "code", ".java": "code", ".cpp": "code", ".go": "code", ".rs": "code",
    ".txt": "text", ".md": "text", ".pdf": "document", ".doc": "document", ".docx": "document", ".csv": "data", ".json": "data", ".xml": "data",
}

# Importance by type of memory, boosts by type of note.
DEFAULT_IMPORTANCE = {"working": 0.6, "episodic": 0.8, "semantic": 0.9, "perceptual": 0.7}
NOTE_BOOST = {"blocker": 0.25, "action": 0.15, "conclusion": 0.10, "task_state": 0.08, "reference": 0.05, "general": 0.0}

# Words at which a question is cut into key words for table matching.
QUESTION_SEPARATORS = [
    "查找", "查询", "搜索", "统计", "计算", "列出", "显示", "展示", "的", "中", "在", "和", "与", "或", "关于", "按照", "根据", "每个", "所有", "全部", "哪些", "什么", "谁", "哪个", "怎么", "如何", "多少", "几", "第",
]
