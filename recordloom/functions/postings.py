"""What a posting's page says about itself: unit, type of unit, title, and whether it is one at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_class

# Labels before a unit's name, names in titles, and what is cut from titles.
UNIT_LABEL = r"(?:招聘单位|公司名称|企业名称|单位名称)[：:]\s*([^\n，。；;]{2,80})"
UNIT_IN_TITLE = r"招聘_([^_\n]{2,80}?)招聘(?:\s*[-_|]|$)"
UNIT_SUFFIX = r"(?:^|_)([^_]{2,80}?(?:有限责任公司|股份有限公司|有限公司|银行|证券|基金|保险|律师事务所|研究院|研究所|大学|学院|集团))"
TITLE_BRACKET, TITLE_YEAR = r"^\[[^\]]+\]\s*", r"^(?:2027届|2027|27届)(?:校园招聘|校招)?[-_]?"
TITLE_SITES = r"(?i)\s*[-_|]\s*(?:应届生求职网|智联招聘|前程无忧).*$"
TITLE_TAILS = [r"(?i)\s*招聘_.+?招聘\s*$", r"(?i)\s*招聘_.+$"]

# Types of unit by name, in the order in which they are tried.
UNIT_TYPES = [("烟草", "烟草系统"), ("银行|证券|基金|保险|信托|期货", "金融机构"), ("律师事务所", "律所"), ("科学院|研究院|研究所", "科研院所"), ("百度|美团|腾讯|阿里|字节|京东|科技|半导体|电子", "大型科技企业")]
UNIT_TYPE_OTHERWISE = "其他企业"
LISTED_UNIT = "收录单位"

# Hosts of collections, titles that name no single posting, the year and the major that are looked for.
AGGREGATORS = ["yingjiesheng.com", "zhaopin.com", "51job.com", "iguopin.com"]
GENERIC_TITLE = "(?:招贤纳士|人才招聘|招聘信息|招聘公告|招聘首页|招聘系统|校园招聘首页|全部职位|职位列表|岗位列表|职位库|岗位库|职位池|岗位池|资讯|请访问|查看岗位详情|投递简历|官方网站)"
NO_TITLE = [
    r"(?i)^https?://", GENERIC_TITLE, "^(?:招聘岗位|职位描述|职位详情|推荐职位)$", "^(?:有限公司|有限责任公司|股份有限公司|集团|公司)$", "^(?:2027|2027届|27届)?校园$",
    "招聘_.+(?:公司|集团|研究院|研究所|银行|证券|基金|保险)", r"(?:\/[^/]+){3,}", "^(?:2027|2027届|27届)?(?:校园招聘|校招|秋季招聘|春季招聘)$", "^.{0,45}(?:2027|27届).{0,8}(?:校园招聘|校招)$",
]
OF_YEAR = r"2027\s*(?:届|年度|校园招聘|校招)|27届|招聘年度[：:]?\s*2027"
LAW_MAJOR = "(?:专业要求|招聘专业|所学专业|专业方向|专业类别|专业背景|专业)[：:]?[^。；;\\n]{0,45}(?:法学|法律(?:硕士|专业|相关专业|类)?)(?:等相关专业)?|(?:法学|法律硕士|法律专业|法律相关专业)(?:类|专业|背景|方向|相关)?"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s　 ]+", " "))


def from_aggregator(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    found = F.lit(False)
    for domain in AGGREGATORS:
        found = found | (host == domain) | F.endswith(host, F.lit("." + domain))
    return F.coalesce(found, F.lit(False))


def unit_name(title: Column, text: Column, source_unit: Column, collected: Column) -> Column:
    """The unit's name: the source's own, but for pages of collections a labelled one, one in the title, or one by its suffix."""
    found = lambda c, p: F.nullif(clean(F.regexp_extract(c, p, 1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(clean(title), TITLE_BRACKET, ""), TITLE_YEAR, "")
    return F.when(~collected, source_unit).otherwise(F.coalesce(found(text, UNIT_LABEL), found(title, UNIT_IN_TITLE), F.nullif(F.regexp_extract(bare, UNIT_SUFFIX, 1), F.lit("")), source_unit))


def unit_type(unit: Column, source_unit: Column, source_type: Column, collected: Column) -> Column:
    """The source's type where the unit is its own, else by the name."""
    own = ~collected | (F.coalesce(unit == source_unit, F.lit(False)) & ~F.contains(source_unit, F.lit(LISTED_UNIT)))
    return F.when(own, source_type).otherwise(first_class(unit, UNIT_TYPES, UNIT_TYPE_OTHERWISE))


def posting_title(page_title: Column, unit: Column) -> Column:
    """A page's title without site names, years and the unit's name."""
    out = F.regexp_replace(clean(page_title), TITLE_SITES, "")
    for cut in TITLE_TAILS:
        out = F.regexp_replace(out, cut, "")
    out = F.regexp_replace(F.regexp_replace(out, TITLE_BRACKET, ""), TITLE_YEAR, "")
    return F.when(F.startswith(out, unit), clean(F.substring(out, F.length(unit) + 1, F.length(out)))).otherwise(out)


def specific_title(value: Column) -> Column:
    """Whether a title names one posting."""
    title = F.regexp_replace(clean(value), r"^[「『【\[]+|[」』】\]]+$", "")
    bad = F.lit(False)
    for p in NO_TITLE:
        bad = bad | title.rlike(p)
    return F.coalesce(F.length(title).between(2, 120) & ~bad, F.lit(False))


def of_year(text: Column) -> Column:
    return F.coalesce(text.rlike(OF_YEAR), F.lit(False))


def law_major(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", "").rlike(LAW_MAJOR), F.lit(False))


def candidate(title: Column, text: Column, announcement: Column, application: Column, direct) -> Column:
    """Whether a text is a posting to keep: a title of its own, the year, the major, and a link to it or a mail address.

    direct: a test of URLs, such as functions.text.detail_url.
    """
    link = F.coalesce(F.startswith(F.lower(application), F.lit("mailto:")), F.lit(False)) | direct(application) | direct(announcement)
    about = F.concat_ws(" ", title, text)
    return specific_title(title) & of_year(about) & law_major(about) & link
