"""Fixed values of requirement clauses: codes and the wording that stands for them."""

# Education levels, degrees, majors and candidate groups by wording.
EDUCATION_CODES = {"本科": "BACHELOR", "硕士": "MASTER", "研究生": "GRADUATE", "博士": "DOCTOR"}
DEGREE_CODES = {"学士": "BACHELOR_DEGREE", "硕士": "MASTER_DEGREE", "博士": "DOCTOR_DEGREE"}
DEGREE_SCOPES = {"学士": "BACHELOR", "硕士": "MASTER", "博士": "DOCTOR"}
MAJOR_CODES = {"法学": "LAW_STUDIES", "法律": "LAW", "法硕": "JURIS_MASTER", "法硕(非法学)": "JURIS_MASTER_NON_LAW", "法律硕士": "JURIS_MASTER", "法律硕士(非法学)": "JURIS_MASTER_NON_LAW", "知识产权": "INTELLECTUAL_PROPERTY"}
MAJOR_FAMILIES = {"法学类": "LAW_STUDIES_FAMILY", "法律类": "LEGAL_PROGRAM_FAMILY"}
COHORT_CODES = {
    "应届毕业生": "FRESH_GRADUATE", "应届生": "FRESH_GRADUATE", "非应届毕业生": "NON_FRESH_GRADUATE", "非应届生": "NON_FRESH_GRADUATE", "在读学生": "CURRENT_STUDENT",
    "留学回国人员": "OVERSEAS_RETURNING_GRADUATE", "留学回国毕业生": "OVERSEAS_RETURNING_GRADUATE", "社会人员": "SOCIAL_CANDIDATE",
}
EDUCATION_RANKS = {"OTHER": 0, "BACHELOR": 1, "MASTER": 2, "DOCTOR": 3}

# General conditions, which never become facts.
GENERAL = ["品行良好", "身体健康", "符合有关法律法规规定", "其他不得报考情形", "具备良好职业素养"]

# The patterns of clauses, without white space and list marks, in the order in which they are tried.
LIST_MARK = r"^(?:(?:\d+|[一二三四五六七八九十百]+)[.．、)）]|[（(](?:\d+|[一二三四五六七八九十百]+)[)）])"
FOR_COHORT = r"^(应届毕业生|应届生|非应届毕业生|非应届生|在读学生|留学回国人员|留学回国毕业生|社会人员)(?:须|要求|应当)[:：]?(.+)$"
INTERNSHIP = r"^(?:(国内外知名院校)(?:的)?)?法学专业(?:(\d{4})年应届|(\d{4})届及之后(?:的)?)在校本科生或研究生$"
LAW_BACHELOR_MASTER = r"^(?:拥有)?(?:(国内外知名院校)(?:的)?)?法学专业本硕学历$"
LAWYER_YEARS = r"^(?:拥有)?(\d+)[-—~～至到](\d+)年律师工作经验[,，]?并持有律师执业证$"
EDUCATION = r"^(?:学历(?:要求)?|最低学历)[:：]?(本科|硕士|研究生|博士)(及以上|以上)?$"
DEGREE = r"^(?:学位(?:要求)?|最低学位)[:：]?(学士|硕士|博士)(?:学位)?(及以上|以上)?$"
GENDER = r"^(?:性别(?:要求)?[:：]?)?(?:仅限|限)?(男性|女性|男|女)$"
GENDER_ANY = r"^(?:性别(?:要求)?[:：]?)?(?:不限|任何)$"
AGE_RANGE = r"^(?:年龄(?:要求)?[:：]?)?(\d{1,2})周岁(以上|及以上|大于)(?:至|到|[-—~～]|[,，、])?(\d{1,2})周岁(以下|及以下|以内|不超过|小于|不满)(?:[(（](?:截至|计算至)(\d{4})年(\d{1,2})月(\d{1,2})日[)）])?$"
AGE = r"^(?:年龄(?:要求)?[:：]?)?(?:不超过|不满|小于等于|≤)?(\d{1,2})周岁(?:以下|以内)?(?:[(（](?:截至|计算至)(\d{4})年(\d{1,2})月(\d{1,2})日[)）])?$"
COHORT_YEAR = r"^(?:招聘对象|人员范围|应聘人员)?[:：]?(?:仅限|限)?(\d{4})届(应届毕业生|毕业生)?$"
COHORT_NAMED = r"^(?:人员范围|招聘对象|应聘人员)[:：]?(?:仅限|限)?(.+)$"
COHORT_ONLY = r"^(?:仅限|限)(应届毕业生|应届生|非应届毕业生|非应届生|在读学生|留学回国人员|留学回国毕业生|社会人员)$"
EXPERIENCE = r"^(?:工作经历(?:要求)?[:：]?)?(?:具有|具备)?(\d+)年以上(.+?)(?:工作)?经验(?:[(（](?:截至|计算至)(\d{4})年(\d{1,2})月(\d{1,2})日[)）])?$"
EXPERIENCE_RANGE = r"^(?:工作经历(?:要求)?[:：]?)?(?:拥有|具有|具备)?(\d+)[-—~～至到](\d+)年(.+?)(?:工作)?经验$"
EXPERIENCE_TAIL = r"(?:相关)?工作$"
EXPERIENCE_OPEN = r"^(?:相关|不限|通用)$"
HOUSEHOLD = r"^(?:户籍)(?:要求)?[:：]?(.+)$"
ORIGIN = [r"^(?:生源地)(?:要求)?[:：]?(.+)$", r"^(?:生源)(?:要求)?[:：]?(.+)$"]
REGION_ANY = r"^(?:不限|无要求)$"
MAJOR_RELATIONS = [
    (r"^(?:本科专业要求与研究生专业要求同时满足|本科和研究生专业均须满足)$", "AND"),
    (r"^(?:本科专业要求或研究生专业要求满足其一|本科或研究生专业要求二选一)$", "OR"),
    (r"^(?:仅比较|以)最高学历(?:对应|所学)专业(?:为准)?$", "HIGHEST_DEGREE_ONLY"),
    (r"^(?:仅要求|只要求)研究生专业$", "GRADUATE_ONLY"),
    (r"^(?:仅要求|只要求)本科专业$", "UNDERGRADUATE_ONLY"),
    (r"^(?:本科或研究生任一层级专业满足即可|本科、研究生任一专业层级满足即可)$", "EITHER_LEVEL"),
]
MATCH_RULES = {"专业代码精确匹配": "EXACT_CODE", "专业名称精确匹配": "EXACT_NAME", "专业类别匹配": "CATEGORY"}
MATCH_CODES = r"^专业代码集合[:：](.+)$"
MATCH_DIRECTORY = r"^专业按外部目录匹配$"
MATCH_EXCEPTIONS = r"^专业匹配按例外清单审查$"
LAW_BOTH = r"^本硕均(?:要求|为|须为)法学(?:专业)?$"
MAJOR_LAYERED = r"^本科专业[:：]?不限[,，]硕士(?:专业)?(?:要求)?[:：]?(.+)$"
MAJOR_SCOPED = [r"^(本科|硕士|研究生|博士)(?:阶段)?(?:所学)?(?:专业(?:要求)?)?[:：](.+)$", r"^(本科|硕士|研究生|博士)(?:必须|须|应)(?:为|是)(.+?)(?:专业)?$"]
MAJOR_ANY = r"^(?:专业)?(?:不限|无要求)$"
MAJOR_UNRESTRICTED = r"^(?:专业(?:要求)?[:：]?)?不限$|^专业不限$"
QUALIFICATION = "法律职业资格"
QUALIFICATION_PREFERRED = "优先"
QUALIFICATION_FIRM = "(?:必须|须|要求|应当|应取得|须取得)"
QUALIFICATION_REQUIRED = "(?:必须|须|要求|应当|应取得|须取得|取得|通过|持有|具有).*法律职业资格|法律职业资格.*(?:必须|须|要求)"
QUALIFICATION_CLASS = "([ABC])类法律职业资格"
PRACTICE_CERTIFICATE = r"^(?:必须|须|要求|应当|应取得|须取得|取得|持有|具有)?律师执业证(?:书)?$"
MAJOR_LAW = r"^(?:(?:所学)?专业(?:要求)?[:：]?)?(?:法学|法律)(?:专业|学科|学)?$|^(?:法律硕士|法硕)(?:\(非法学\))?(?:专业)?$|^(?:法学类|法律类)$"
SUBJECTIVE = "(?:知名院校|著名律所|成绩优秀|法律思维|法律运用能力|法律工作.*热情|抗压能力|团队合作|沟通能力|市场拓展能力|文化和价值观念|视情况安排|每周实习至少|完整实习\\d+个月|商事诉讼|仲裁案件|独立出庭)"
CONDUCT = "(?:中华人民共和国国籍|政治立场|政治态度|理想信念|思想品德|遵纪守法|诚实守信|品行端正|人格健全|身体健康|身体条件|现役军人|刑事处罚|劳动教养|开除公职|失信被执行人|党纪|政纪处分)"

# What goes from a list of majors before it is cut, where it is cut, and what goes from each item.
MAJOR_LIST_CUTS = [r"^(?:专业(?:要求)?[:：]?)", r"(?:任选其一|之一|均可)$", r"等相关专业$", r"相关专业$", r"专业$"]
MAJOR_LIST_MARKS = r"[,，、/]|或"
MAJOR_ITEM_CUT = r"^(?:包括|限于|要求)"
PROGRAM_CODE_FIRST = r"^([A-Za-z0-9][A-Za-z0-9.-]*)(?:[(（](.+)[)）]|(.+))?$"
PROGRAM_LABEL_FIRST = r"^(.+?)[(（]([A-Za-z0-9][A-Za-z0-9.-]*)[)）]$"

# What a single major expression means: pattern, semantic type, scope, identity, kind of identity, in the order in which it is tried.
MAJOR_EXPRESSIONS = [
    (r"^(?:专业)?不限$", "ANY_MAJOR", "UNRESTRICTED", "ANY_MAJOR", "UNRESTRICTED"),
    (r"^(?:法律硕士|法硕)\(非法学\)$", "EXACT_IDENTITY", "CLOSED", "LAW_MASTER_NON_LAW", "EXACT"),
    (r"^(?:法律硕士|法硕)\(法学\)$", "EXACT_IDENTITY", "CLOSED", "LAW_MASTER_LAW", "EXACT"),
    (r"^法律\(非法学\)$", "EXACT_IDENTITY", "CLOSED", "LAW_NON_LAW", "EXACT"),
    (r"^法律\(法学\)$", "EXACT_IDENTITY", "CLOSED", "LAW_LAW", "EXACT"),
    (r"^(?:法律\(0351\)|0351法律)$", "EXACT_IDENTITY", "CLOSED", "LAW_0351", "DIRECTORY_REFERENCE"),
    (r"^法律$", "LAW", "CLOSED", "LAW_GENERAL", "EXACT"),
    (r"^法学$", "EXACT_IDENTITY", "CLOSED", "LAW_STUDIES", "EXACT"),
    (r"^法学类$", "LAW_FAMILY", "CLOSED", "LAW_STUDIES_FAMILY", "CATEGORY"),
    (r"^法律类$", "LAW_FAMILY", "CLOSED", "LEGAL_PROGRAM_FAMILY", "CATEGORY"),
    (r"^法律相关(?:专业)?$", "LAW_RELATED", "OPEN", "LAW_RELATED", "OPEN_REFERENCE"),
    (r"(?:相关专业|相近专业|相关学科|以及其他|其他相关|^等$)", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED"),
    (r"^知识产权$", "OTHER_EXPLICIT", "CLOSED", "INTELLECTUAL_PROPERTY", "EXACT"),
]
MAJOR_EXPRESSION_OTHERWISE = ("OTHER_EXPLICIT", "CLOSED", "OTHER_EXPLICIT", "EXACT")
