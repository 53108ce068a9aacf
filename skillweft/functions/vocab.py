"""Word lists, tables and patterns that decide results."""

CORE_KEYWORDS = ("负责", "职责", "要求", "经验", "熟悉", "掌握", "具备", "优先", "开发", "设计", "维护", "测试", "交付", "能力", "技能", "responsib", "requir", "experience", "skill", "develop", "design", "build", "manage", "support", "ability")
BAD_FORMAT = r"([\p{L}])\1{19,}|[\x00-\x08\x0b\x0c\x0e-\x1f]"
INTERN = r"(?i)\bintern(?:ship)?s?\b"
PART_TIME = r"(?i)\bpart[\s_\-]?time\b"
STACK_SEPARATOR = r"[/、＋+，,·]"
RECRUIT_SPAM = "接受应届|无经验|不限语言|线上面试|可投|高薪|急招|双休|16薪|14薪|六险一金|拒绝内卷|月入过万|核心项目|年终奖|导师带教|长期项目"
POSITION_WORDS = (
    "工程师|开发|分析|设计|运营|经理|架构|研究|评测|技术|主管|顾问|讲师|教师|销售|助理|专家|咨询|运维|实施|产品|专员|管培|储备|总监|教练|审核|主播|护士|客服|财务|人事|市场|编辑|司机|厨师|保安|保洁|前台|全栈|算法|数据|后端|标注|训练|翻译|美工|剪辑|修图|撰写|美编|策划|摄影|摄像|主持|文员|秘书|软件测试|测试开发|测试工程师"
    "|Engineer|Developer|Analyst|Manager|Architect|Scientist|Researcher|Specialist|Consultant|Director|Officer|Operator|Designer|Editor|Nurse|Driver|Chef|Trainer|Coordinator|Administrator|Intern|Trainee|Tester|Lead|Principal|Staff"
)

ID_CARD = r"(?<!\d)\d{17}[\dXx](?!\d)"
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

SKILL_SUFFIXES = ("工程师", "中间件", "技术", "系统", "框架", "平台", "工具", "软件", "开发", "设计", "管理", "应用", "方案", "产品", "项目", "算法", "架构", "引擎", "组件", "协议", "标准", "接口")
SOFT_SKILLS = ("团队协作", "沟通能力", "项目管理", "需求分析", "产品设计", "问题解决", "逻辑思维", "学习能力", "抗压能力", "时间管理", "领导力", "跨部门协作", "创新思维", "客户服务意识", "责任心", "主动性", "文档撰写", "汇报能力", "数据分析思维", "执行力")
#: Trades, benefits and fragments that are no skills.
SKILL_STOPWORDS = (
    "保险", "金融", "银行", "证券", "地产", "零售", "电商", "餐饮",
    "医疗", "教育", "旅游", "物流", "汽车", "能源", "制造", "农业",
    "传媒", "广告", "娱乐", "生活服务", "车联网", "无人机组装测试", "五险", "五险一金",
    "社保", "公积金", "双休", "不加班", "福利", "年终奖", "提成", "股票期权",
    "运营", "销售", "客服", "市场", "行政", "财务", "人力资源", "公关",
    "采购", "前台", "助理岗", "兼职", "实习岗", "微", "软件",
)
#: Other spellings of skills: the key as it is, or the lower-cased text.
SKILL_ALIASES = {
    "JS": "JavaScript",
    "TS": "TypeScript",
    "C++": "C++",
    ".net": ".NET",
    "c/c++": "C++",
    "c语言": "C",
    "c#": "C#",
    "golang": "Go",
    "spring": "Spring Boot",
    "springboot": "Spring Boot",
    "springcloud": "Spring Cloud",
    "vue": "Vue.js",
    "react": "React",
    "node": "Node.js",
    "express": "Express.js",
    "mybatis": "MyBatis",
    "hadoop": "Hadoop",
    "spark": "Apache Spark",
    "flink": "Apache Flink",
    "kafka": "Apache Kafka",
    "pyspark": "PySpark",
    "k8s": "Kubernetes",
    "docker": "Docker",
    "pytorch": "PyTorch",
    "tf": "TensorFlow",
    "sklearn": "scikit-learn",
    "numpy": "NumPy",
    "pandas": "Pandas",
    "大模型": "大语言模型",
    "llm": "大语言模型",
    "rag": "检索增强生成",
    "自然语言处理算法": "自然语言处理",
    "深度学习算法": "深度学习",
    "机器学习算法": "机器学习",
    "sql": "SQL",
    "mysql": "MySQL",
    "pg": "PostgreSQL",
    "redis": "Redis",
    "mongo": "MongoDB",
    "es": "Elasticsearch",
    "git": "Git",
    "jenkins": "Jenkins",
}
#: Standard skills where no longer list is given (``sources.readers.whitelist`` reads one).
SKILL_WHITELIST = (
    "Python", "Java", "JavaScript", "TypeScript", "Go", "Rust", "C++", "C#",
    "Ruby", "PHP", "Swift", "Kotlin", "Scala", "R", "MATLAB", "Shell",
    "C", "SQL", "React", "Vue.js", "Angular", "HTML", "HTML5", "CSS",
    "Webpack", "Vite", "Tailwind CSS", "Next.js", "Nuxt.js", "Bootstrap", "ECharts", "Three.js",
    "数据可视化", "UI设计", "前端工程化", "React Native", "jQuery", "ElementUI", "Spring Boot", "Spring Cloud",
    "Django", "Flask", "FastAPI", "Express.js", "Node.js", "ASP.NET", "Microservices", "MyBatis",
    "Scrapy", "RESTful API", "REST", "JSON", "API", "MySQL", "PostgreSQL", "MongoDB",
    "Redis", "Elasticsearch", "SQLite", "Oracle", "SQL Server", "Cassandra", "ClickHouse", "NoSQL",
    "Hadoop", "Apache Spark", "Apache Flink", "Apache Kafka", "Hive", "HBase", "Airflow", "PySpark",
    "数据治理", "ETL", "Snowflake", "数据建模", "数据挖掘", "Docker", "Kubernetes", "Jenkins",
    "Git", "GitHub Actions", "Terraform", "Ansible", "Prometheus", "Grafana", "CI/CD", "Nginx",
    "系统运维", "AWS", "Azure", "GCP", "Linux", "DevOps", "PyTorch", "TensorFlow",
    "scikit-learn", "大语言模型", "检索增强生成", "机器学习", "深度学习", "自然语言处理", "计算机视觉", "数据分析",
    "OpenAI API", "LangChain", "LlamaIndex", "大模型算法", "推荐算法", "图像算法", "风控算法", "强化学习",
    "SLAM算法", "广告算法", "AIGC", "多模态模型", "语音识别", "运筹优化算法", "具身智能", "机器人",
    "OpenCV", "嵌入式开发", "自动化测试", "多线程", "三维开发", "GIS开发", "大模型评测", "音频标注",
    "视频标注", "AI", "Transformer", "Agentic AI", "Pandas", "NumPy", "Matplotlib", "统计学",
    "Excel", "Tableau", "Power BI", "SAS", "Agile", "Scrum", "Maven", "JUnit",
    "Hibernate", "JDBC", "Core Java", "JIRA", "SIEM", "SOAR", "团队协作", "沟通能力",
    "项目管理", "需求分析", "产品设计", "问题解决", "逻辑思维", "学习能力", "抗压能力", "时间管理",
    "领导力", "跨部门协作", "创新思维", "客户服务意识", "责任心", "主动性", "文档撰写", "汇报能力",
    "数据分析思维", "执行力",
)

#: What mined names are instead of skills.
GENERIC_NOISE = (
    "前端", "后端", "测试", "运维", "算法", "数据库", "大数据", "云",
    "安全", "网络", "搜索", "配置", "操作", "脚本", "报表", "开源",
    "移动", "桌面", "嵌入式", "数据", "框架", "平台", "系统", "项目",
    "团队", "业务", "产品", "架构", "开发", "技术", "管理", "设计",
    "工具", "接口", "协议", "引擎", "服务", "组件", "方案", "功能",
    "经验", "工作", "能力", "要求", "方向", "语言",
)
COMPOUND_NOISE = r"[\/()（）]|天/|月/|年/"
POSITION_NOISE = r"(工程师|技术员|开发工程师|开发$|专员|经理|主管|负责人|设计师|架构师|分析师|科学家|研究员|顾问|专家|实习生|助理|店长)$"
EXPERIENCE_NOISE = r"(经验|开发|部署|使用|掌握|熟悉|了解|能力|经验$|方向)"

PROFICIENCY = ((("精通", "深入", "专家", "资深"), "高级"), (("掌握", "熟练", "独立"), "中级"), (("熟悉", "了解", "入门", "基础"), "初级"))
EDUCATION = (("博士", 4), ("硕士", 3), ("研究生", 3), ("本科", 2), ("学士", 2), ("大专", 1), ("专科", 1), ("高中", 0), ("中专", 0))

UNIT_HOURS = (("months", 160.0), ("hours", 1.0), ("weeks", 40.0), ("years", 1920.0), ("month", 160.0), ("hour", 1.0), ("days", 8.0), ("week", 40.0), ("year", 1920.0), ("day", 8.0), ("小时", 1.0), ("h", 1.0), ("天", 8.0), ("周", 40.0), ("月", 160.0), ("年", 1920.0))
INTERNATIONAL_SOURCES = ("indeed", "monster", "glassdoor", "linkedin_public")
DAYS_PER_MONTH, USD_RATE = 21, 7.0

LEVELS = ("初级", "中级", "高级", "资深", "专家")
EXPERIENCE_CEILING = dict(zip(LEVELS, (3, 5, 8, 10, 12), strict=True))
SKILL_CEILING = dict(zip(LEVELS, (5, 8, 12, 15, 20), strict=True))
EXPERT_CEILING = dict(zip(LEVELS, (0, 2, 4, 6, 10), strict=True))
EDUCATION_CEILING = dict(zip(LEVELS, (2, 3, 3, 4, 4), strict=True))
INFLATION_WEIGHTS = {"experience": 0.689, "skill_count": 0.695, "skill_depth": 0.448, "education": 0.622}
MATCH_WEIGHTS = {"must": 0.673, "nice": 0.129, "exp": 0.198}
DISCOVERY_WEIGHTS = {"count": 0.4, "source": 0.3, "growth": 0.3}

PLATFORM_AUTHORITY = {"coursera": 1.0, "edx": 1.0, "icourse163": 0.7}
PROJECT_KEYWORDS = ("实战", "项目", "案例", "实操", "实训", "开发", "构建", "实现", "project", "hands-on", "build", "implement", "case study")

#: Position families by the first keyword that a name holds.
POSITION_FAMILIES = (
    (("架构",), "架构师"),
    (("测试",), "测试工程师"),
    (("运维",), "运维工程师"),
    (("网络",), "网络工程师"),
    (("嵌入式",), "嵌入式开发工程师"),
    (("算法", "推荐", "图像", "视觉", "语音", "NLP", "自然语言", "大模型", "深度学习", "机器学习", "AI", "人工智能", "风控"), "算法工程师"),
    (("数据开发", "大数据", "数仓", "ETL"), "大数据开发工程师"),
    (("数据分析", "商业分析", "数据挖掘"), "数据分析师"),
    (("前端", "web", "h5", "html", "css", "ui"), "前端开发工程师"),
    (("后端", "后台", "服务端"), "后端开发工程师"),
    (("java",), "Java开发工程师"),
    (("python",), "Python开发工程师"),
    (("golang", "go"), "Go开发工程师"),
    (("c/c++", "c++", "c语言"), "C++开发工程师"),
    (("全栈",), "全栈工程师"),
    (("游戏",), "游戏开发工程师"),
    (("硬件",), "硬件工程师"),
    (("软件",), "软件开发工程师"),
    (("科学家",), "科学家"),
    (("研究员",), "研究员"),
    (("专家",), "专家"),
    (("顾问",), "顾问"),
)
ANALYST_FAMILIES = (
    (("量化", "quant"), "量化分析师"),
    (("精算", "actuar"), "精算分析师"),
    (("投资", "invest"), "投资分析师"),
    (("信贷", "贷款", "credit", "mortgage", "抵押"), "信贷分析师"),
    (("保险", "再保险", "insur"), "保险分析师"),
    (("财务", "金融", "财会", "融资"), "财务分析师"),
    (("商业智能", "bi", "intelligence"), "商业智能分析师"),
    (("市场", "market", "marketing"), "市场分析师"),
    (("可持续", "sustain"), "可持续发展分析师"),
    (("业务", "business"), "业务分析师"),
    (("策略", "strategy", "planning"), "策略分析师"),
    (("数据建模", "数据挖掘"), "数据分析师"),
)
TECH_STACKS = (("小程序", "小程序"), ("鸿蒙", "鸿蒙"), ("移动端", "移动端"), ("移动", "移动"), ("桌面", "桌面"), ("可视化", "可视化"), ("大屏", "大屏"), ("next.js", "Next.js"), ("three.js", "Three.js"), ("typescript", "TypeScript"), ("react", "React"), ("vue", "Vue"), ("angular", "Angular"), ("node", "Node.js"), ("echarts", "ECharts"), ("uni-app", "uni-app"), ("taro", "Taro"), ("electron", "Electron"), ("webgl", "WebGL"))
POSITION_STOPWORDS = ("技术", "开发", "工程师", "管理", "专员", "前台", "文员")
POSITION_PREFIX = r"^(初级|中级|高级|资深|专家|助理|实习|见习|应届|研发)"
POSITION_SUFFIX = r"(工程师|技术员|程序员|研发人员|研发|开发|设计师|经理|主管|负责人|专员|分析师|科学家|研究员|专家|顾问|高级)$"
#: English job titles.
EN_POSITIONS = {
    "software engineer": "软件工程师",
    "senior software engineer": "软件工程师",
    "staff software engineer": "软件工程师",
    "software developer": "软件工程师",
    "software developer, experiment controls": "软件工程师",
    "backend software engineer": "后端开发工程师",
    "back end developer": "后端开发工程师",
    "backend developer": "后端开发工程师",
    "backend engineer": "后端开发工程师",
    "frontend engineer": "前端开发工程师",
    "frontend software engineer": "前端开发工程师",
    "front end developer": "前端开发工程师",
    "frontend developer": "前端开发工程师",
    "full stack engineer": "全栈工程师",
    "full-stack engineer": "全栈工程师",
    "fullstack engineer": "全栈工程师",
    "full stack developer": "全栈工程师",
    "data scientist": "数据分析师",
    "data analyst": "数据分析师",
    "senior data analyst": "数据分析师",
    "business analyst": "数据分析师",
    "analytics engineer": "数据分析师",
    "data engineer": "大数据开发工程师",
    "machine learning engineer": "机器学习工程师",
    "ml engineer": "机器学习工程师",
    "machine learning operations engineer": "机器学习工程师",
    "ai engineer": "算法工程师",
    "nlp engineer": "算法工程师",
    "applied scientist": "算法工程师",
    "qa engineer": "测试工程师",
    "software test engineer": "测试工程师",
    "senior quality engineer": "测试工程师",
    "devops engineer": "运维工程师",
    "site reliability engineer": "运维工程师",
    "sre": "运维工程师",
    "network engineer": "网络工程师",
    "network production engineer": "网络工程师",
    "embedded engineer": "嵌入式开发工程师",
    "desktop engineer": "桌面工程师",
    "security engineer": "网络安全工程师",
    "cyber security engineer": "网络安全工程师",
    "quantitative analyst": "量化分析师",
    "quant analyst": "量化分析师",
    "quantitative developer": "量化分析师",
    "product manager": "产品经理",
    "project manager": "项目经理",
    "product engineer": "产品工程师",
    "ui designer": "UI设计师",
    "ux designer": "UX设计师",
    "founding engineer": "创始工程师",
    "founding product engineer": "创始工程师",
    "forward deployed engineer": "现场工程师",
    "customer engineer": "客户工程师",
    "analyst, strategy & analytics": "数据分析师",
    "analytics avp": "数据分析师",
    "applications development technology lead analyst": "数据分析师",
    "business analytics senior analyst": "数据分析师",
    "data analysis manager": "数据分析师",
    "director, planning & analytics": "数据分析师",
    "fsr analyst": "数据分析师",
    "financial & credit analytics analyst": "数据分析师",
    "manager capital markets financial analysis": "数据分析师",
    "model/anlys/valid sr analyst": "数据分析师",
    "senior measurement analyst": "数据分析师",
    "senior statistical analyst": "数据分析师",
    "specialist, hr data, analytics & insights": "数据分析师",
    "sr analyst intl solutions business intelligence": "数据分析师",
    "sr. analyst, marketing analytics": "数据分析师",
    "visualization software and data specialist": "数据分析师",
    "data automation engineer": "大数据开发工程师",
    "kafka streaming architect": "大数据开发工程师",
    "snowflake engineer": "大数据开发工程师",
    "inference engineer, gpu kernel optimization": "算法工程师",
    "advanced cyber threat response & forensics lead/manager": "网络安全工程师",
    "threat context analyst": "网络安全工程师",
    "member of technical staff": "软件开发工程师",
    "principal subsystem engineer": "软件开发工程师",
    "regulatory developer vp": "软件开发工程师",
    "seismic developer": "软件开发工程师",
    "engineering manager, platform engineering": "运维工程师",
    "senior supervisor, quality engineering": "测试工程师",
    "sensor test r&d mechatronics engineer": "嵌入式开发工程师",
    "rfic system engineer": "硬件工程师",
}

STATES = ("candidate", "emerging", "stable", "declining", "archived", "rejected")
TRANSITIONS = (("candidate", "emerging"), ("candidate", "rejected"), ("emerging", "stable"), ("emerging", "declining"), ("stable", "declining"), ("declining", "stable"), ("declining", "archived"))

POLLUTED_POSITIONS = ("解决方案", "DevOps 工具", "站点可靠性", "系统")
EDUCATION_LEVELS = ("博士", "硕士", "本科", "大专")
EXPERIENCE_IN_CONTEXT = r"经验[^\d年]{0,4}(\d+(?:\.\d+)?)\s*年|(\d+(?:\.\d+)?)\s*年[^\d]{0,4}经验"
YEARS = r"(?<!\d)(?!19\d{2}|20\d{2})(\d+(?:\.\d+)?)\s*年"
NOT_SKILLS = ("前端开发", "后端开发", "通信/物联网/自动化", "嵌入式", "固定年终", "周末加班双薪", "经验不限", "1-3年", "3-5年", "5-10年", "10年以上", "大专", "本科", "硕士", "博士", "学历不限", "5天/周", "4天/周", "3天/周", "6天/周", "3个月", "6个月", "9个月", "12个月", "Remote", "全职", "兼职", "实习")
#: Kinds of positions by the first keyword that a title holds.
GOLDEN_CATEGORIES = (
    (("后端", "Python", "Java", "Go", "C++", "服务端"), "后端"),
    (("前端", "Vue", "React", "Web", "H5"), "前端"),
    (("算法", "机器学习", "深度学习", "AI", "大模型", "NLP", "CV"), "算法"),
    (("数据", "大数据", "数开", "数据挖掘", "BI"), "数据"),
    (("全栈",), "全栈"),
    (("测试", "QA"), "测试"),
    (("运维", "DevOps", "SRE"), "运维"),
)
COURSE_SOURCES = ("icourse163", "coursera", "edx")
PAPER_SOURCES = ("arxiv", "github", "stackoverflow")
FRAGMENTS = {"微": "微服务"}
