"""Word lists, weights and patterns that results depend on, in the order in which they are tried."""

# Full-width punctuation and what it is folded to, after NFKC.
PUNCTUATION = {"（": "(", "）": ")", "：": ":", "；": ";", "，": ",", "！": "!", "？": "?"}

# Municipalities with the suffix, and their short names.
MUNICIPALITIES = {"北京市": "北京", "上海市": "上海", "天津市": "天津", "重庆市": "重庆"}

# Cities looked for in a text.
CITIES = ["北京", "上海", "深圳", "广州", "武汉", "杭州", "南京", "成都", "重庆", "天津", "西安", "长沙", "苏州", "厦门", "青岛", "无锡", "全国"]

# Dates, years and mail addresses.
DATE = r"(?<!\d)(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?!\d)"
YEAR = r"(?<!\d)(20\d{2})(?!\d)"
MAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"

# Labels before a deadline and before a start, and how far behind them a date may lie.
DEADLINE_LABELS = ["截止", "报名至", "网申至", "投递至", "结束时间"]
START_LABELS = ["发布时间", "发布日期", "开始时间", "报名时间", "网申时间"]
LABEL_REACH = 28

# Paths of list pages, of single postings, and query names that mark a posting.
LIST_PATHS = [r"(?:^|/)(?:index|list|recruiting)\.html?$", r"/(?:campus|recruit|jobs?)/?$"]
DETAIL_PATHS = [
    r"/(?:detail|jobdetail|post|position|positions|job|jobs|vacancy)(?:/|$)",
    r"/job(?:_z)?-?\d[\d-]*\.html?$",
    r"/(?:news|content)/\d+(?:\.html?)?$",
    r"/content/id/\d+",
]
DETAIL_NAMES = ["jobadid", "jobid", "positionid", "position_id"]

# Education classes by wording.
EDUCATION = [("博士", "硕士及以上"), ("硕士|研究生", "硕士研究生"), ("本科", "本科及以上")]
EDUCATION_OTHERWISE = "学历要求待核验"

# Directions of work, and the one for others.
DIRECTIONS = ["法务", "法律事务", "合规管理", "风险管理", "内控", "审计监督", "投资管理", "经营管理", "战略管理", "综合管理", "管培生", "数据合规", "隐私保护", "商业合规"]
DIRECTION_OTHERWISE = "其他（法律专业可报）"
DIRECTION_LABEL = r"(?:岗位名称|职位名称|招聘岗位|职位)[：:]?([^，。；;\n]{2,32})"

# Directions that raise a score.
RAISED_DIRECTIONS = ["法务", "法律事务", "合规管理", "数据合规", "隐私保护", "商业合规"]

# Terms that exclude.
EXCLUDED_TERMS = [
    "中国建筑", "中国铁建", "中国中铁", "中国交建", "中国能源建设集团", "中国能建", "中国电力建设集团", "中国电建", "中建", "中铁", "中交", "工程局", "建设有限公司", "建筑施工", "建筑工程", "房屋建筑",
    "工程建设", "工程施工", "施工总承包", "施工企业", "房地产开发", "房地产开发建设", "房地产", "地产", "置地", "房产", "工程技术管理", "工程造价", "现场管理", "施工管理", "工程项目管理",
]

# Base scores by type of unit, and the one for others.
UNIT_WEIGHTS = {"中科院体系企业": 5, "央企": 5, "烟草系统": 5, "金融机构": 4, "科研院所": 4, "事业单位": 4, "地方国企": 4, "律所": 4, "大型科技企业": 4, "其他企业": 3, "其他国资背景单位": 3}
WEIGHT_OTHERWISE = 3

# What a text says about other majors than law, without white space.
MAJOR_RULES = [
    (r"(不接受|不招收|不面向).{0,12}(法律硕士[（(]非法学[）)]|法硕[（(]?非法学|非法学背景)|仅限.{0,8}法学(专业|背景|硕士|类)", "不接受"),
    (r"本硕(阶段)?均.{0,8}法学|本科.{0,8}法学.{0,16}硕士.{0,8}法学", "要求本硕均法学"),
    (r"本科(阶段|专业)?.{0,10}(须|需|要求|为)法学|本科法学(专业|背景|毕业)", "要求本科法学"),
    (r"法律硕士[（(]非法学[）)]|法硕[（(]?非法学|非法学背景.{0,6}法律硕士", "明确接受法律硕士（非法学）"),
    (r"法学类|法学专业|法律专业|法律(?:等)?相关专业|法律硕士|法学硕士|法学相关", "可能接受"),
]
MAJOR_OTHERWISE = "专业限制待核验"
REJECTING, ACCEPTING = ["不接受", "要求本科法学", "要求本硕均法学"], "明确接受法律硕士（非法学）"

# Findings of legal work: category, name, pattern.
RELEVANCE_RULES = [
    ("direct", "LEGAL_ROLE_TITLE", "(?:法务岗|法律岗|法律事务岗|法律合规岗|合规法务岗)"),
    ("direct", "LEGAL_REVIEW", "(?:法律审查|合同法律审查|交易法律审查)"),
    ("direct", "LEGAL_DOCUMENT_DRAFTING", "(?:法律文书|合同起草)"),
    ("direct", "DISPUTE_RESOLUTION", "(?:诉讼|仲裁|合同纠纷)"),
    ("direct", "LEGAL_RISK", "法律风险"),
    ("direct", "COMPLIANCE_SYSTEM", "(?:法律合规|监管合规|合规体系|用工合规|销售合规|数据合规|隐私合规|产品法规合规)"),
    ("direct", "LEGAL_ADVICE", "法律咨询"),
    ("direct", "INTELLECTUAL_PROPERTY_LEGAL", "知识产权法律事务"),
    ("direct", "LABOR_LAW", "(?:劳动法|劳动争议)"),
    ("direct", "LEGAL_DUE_DILIGENCE", "法律尽调"),
    ("direct", "LEGAL_APPLICATION", "(?:纪律执法|法律适用)"),
    ("direct", "LEGAL_TECHNOLOGY", "法律科技"),
    ("direct", "TAX_LAW", "税法"),
    ("major", "LAW_MAJOR", "(?:法学类|法学专业|法律专业)"),
    ("major", "LAW_DIRECTORY_0301", r"(?:法学\s*[（(]?0301[）)]?|0301\s*法学)"),
    ("major", "LAW_DIRECTORY_0351", r"(?:法律\s*[（(]?0351[）)]?|0351\s*法律)"),
    ("qualification", "LEGAL_PROFESSIONAL_QUALIFICATION", "法律职业资格"),
    ("adjacent", "CONTRACT_MANAGEMENT", "合同管理"),
    ("adjacent", "RISK_MANAGEMENT", "风险管理"),
    ("adjacent", "COMPLIANCE_MANAGEMENT", "合规管理"),
    ("adjacent", "REGULATORY_FUNCTION", "监管"),
    ("adjacent", "DISCIPLINE_INSPECTION", "纪检监察"),
    ("adjacent", "AUDIT_FUNCTION", "审计"),
    ("adjacent", "DUE_DILIGENCE", "尽调"),
    ("adjacent", "INTERNAL_CONTROL", "内控"),
    ("adjacent", "EMPLOYEE_RELATIONS", "员工关系"),
    ("adjacent", "PRIVACY_OR_SECURITY_GOVERNANCE", "(?:隐私治理|安全治理)"),
    ("adjacent", "STANDARD_OR_CERTIFICATION", "(?:标准|认证)"),
    ("adjacent", "INSTITUTIONAL_GOVERNANCE", "制度建设"),
    ("negative", "MECHANICAL_ENGINEERING", "(?:机械设计|机械制造|工艺设计|产品研发)"),
    ("negative", "SOFTWARE_ENGINEERING", "(?:软件开发|系统开发|程序开发|软件测试|系统架构|代码开发)"),
    ("negative", "FINANCIAL_ACCOUNTING", "(?:会计核算|财务报表|资金管理|账务处理)"),
    ("negative", "SALES_EXECUTION", "(?:销售执行|客户开发|销售指标|市场拓展)"),
    ("negative", "ADMINISTRATION", "(?:行政事务|会议组织|会务工作|后勤保障|人事行政)"),
    ("negative", "TECHNICAL_QUALITY_COMPLIANCE", "(?:技术质量合规|质量标准执行)"),
    ("negative", "MARKET_OR_CREDIT_RISK", "(?:市场风险|信用风险|生产风险|量化风险)"),
    ("negative", "FINANCIAL_OR_TECHNICAL_AUDIT", "(?:财务审计|IT审计|工程审计)"),
    ("negative", "INVESTMENT_ANALYSIS", "(?:估值模型|行业研究|投后运营)"),
    ("negative", "HUMAN_RESOURCES_OPERATIONS", "(?:招聘管理|培训管理|薪酬管理)"),
]
