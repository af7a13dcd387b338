"""What a research note says: rating, action, prices, kind of line."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, SPACE, WS, contains_any, found, normalize_literal, tidy, trim

# Vocabularies, in the order in which they are tried.
RATINGS = ["买入", "增持", "中性", "卖出", "减持", "持有", "跑赢", "跑输", "优于大市", "弱于大市", "Buy", "Hold", "Sell", "OW", "UW", "Overweight", "Underweight"]
ACTIONS = ["首次覆盖", "维持", "上调", "下调", "恢复覆盖", "首予", "新增"]
STANDALONE_ACTIONS = ["首次覆盖", "恢复覆盖", "首予"]
RATING_LEADS = ["评级为", "投资评级", "维持", "首予", "重申", "给予", "上调至", "下调至"]
ACTION_OBJECTS = ["评级", "目标价", "买入", "增持", "中性", "持有", "卖出", "减持", "Buy", "Hold", "Sell", "Overweight", "Underweight", "跑赢", "跑输"]
RATING_ALIASES = {
    "买入": ["买入", "buy", "1h", "1l"],
    "增持": ["增持", "overweight", "ow", "跑赢", "优于大市"],
    "中性": ["中性", "neutral"],
    "持有": ["持有", "hold"],
    "减持": ["减持", "underweight", "uw", "跑输", "弱于大市"],
    "卖出": ["卖出", "sell"],
}
SIGNALS = {"catalyst": ["催化剂", "catalyst"], "risk": ["风险", "risk"], "valuation": ["估值", "valuation"], "financial": ["财务", "营收", "利润"], "macro": ["宏观", "政策", "监管"]}
SIGNAL_LABELS = {"catalyst": "催化剂", "risk": "风险", "valuation": "估值", "financial": "财务", "macro": "宏观"}
SEARCH_MODES = {
    "rating": ["评级", "买入", "增持", "中性", "卖出", "减持", "持有", "首次覆盖", "维持", "上调", "下调", "buy", "hold", "sell", "overweight", "underweight"],
    "target": ["目标价", "tp", "pt", "target price", "港元", "美元", "人民币", "新台币"],
    "signal": ["催化剂", "风险", "估值", "财务", "宏观", "政策", "监管", "订单", "产能"],
}
POSITIVE = ["买入", "增持", "上调", "首予", "首次覆盖", "overweight", "buy"]
NEGATIVE = ["卖出", "减持", "下调", "风险", "underweight", "sell"]
UNKNOWN_INSTITUTION = "未识别机构"
EXCHANGES = ["HK", "SS", "SZ", "US", "TW", "KS", "KQ", "JP", "L", "O", "N", "SI"]
TARGET_UNITS = ["港元", "美元", "元", "新元", "新加坡元", "新台币", "人民币"]
CURRENT_UNITS = ["港元", "美元", "元", "新台币", "人民币"]

# Patterns of prices, codes and names in parentheses.
_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_TARGET_LABEL = "(?:目标价|target price|TP|PT)"
_CURRENT_LABEL = "(?:当前股价|现价|current price)"
_PRICE = f"{_NUMBER}{SPACE}*(?:{'|'.join(TARGET_UNITS)})"
_SPOT = f"({_NUMBER}{SPACE}*(?:{'|'.join(CURRENT_UNITS)})?)"

#: A listed code; its borders look at ASCII letters and digits only.
LISTED_CODE = rf"(?<![A-Za-z0-9_])(?:[0-9]{{4,6}}|[A-Z]{{1,6}})\.(?:{'|'.join(EXCHANGES)})(?![A-Za-z0-9_])"
NAMED_PAREN = rf"([{HAN}A-Za-z][{HAN}A-Za-z0-9&.\-{WS}]{{1,40}})[（(]([^）)]+)[）)]"
MARKUP_PREFIX = rf"^[#>*\-•■{WS}]*"
# What is cut from the ends of a name, what follows a short name, and what is no name.
NAME_LEADS = f"^(?:我们(?:将|对|认为)?|和|与|以及|及|该公司|公司){SPACE}*"
NAME_TAILS = r"(?:覆盖个股|覆盖公司|公司|个股|股份有限公司)\z"
NAME_FOLLOWERS = ("是|为", "股价|股票|股份")
NOISE_NAMES = ("hk", "us", "ss", "sz", "tw", "ah", "ai")
NOISE_WORDS = ["目标价", "评级", "发布日期", "当前股价", "风险", "催化剂"]


def _first(words: list[str], test) -> Column:
    return F.coalesce(*[F.when(test(w), F.lit(w)) for w in words])


def any_word(text: Column, words: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(map(re.escape, words)))


def _within(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rating(text: Column) -> Column:
    """Of a composed text: the word in the first label, else the first word in a rating's place."""
    label = F.lower(F.regexp_extract(text, rf"(?i)(?:投资评级|评级|Rating)[:：]?{SPACE}*[“\"']?([A-Za-z{HAN}]+)", 1))
    lead = "|".join(RATING_LEADS)
    place = lambda w: text.rlike(rf"(?i)(?:{w})[”\"']?{SPACE}*(?:评级|Rating)|(?:{lead}){SPACE}*[“\"']?(?:{w})")
    named = _within(label, lambda x: _first(RATINGS, lambda w: F.contains(x, F.lit(w.lower()))))
    # one test for any word before one test each
    return F.coalesce(named, F.when(place("|".join(RATINGS)), _first(RATINGS, place)))


def action(text: Column) -> Column:
    objects = "|".join(ACTION_OBJECTS)
    place = lambda w: text.rlike(rf"(?i)(?:{w})[^。\n]{{0,20}}(?:{objects})|(?:评级|目标价|target price|Rating)[^。\n]{{0,20}}(?:{w})")
    return F.coalesce(_first(STANDALONE_ACTIONS, lambda w: F.contains(text, F.lit(w))), F.when(contains_any(text, ACTIONS) & place("|".join(ACTIONS)), _first(ACTIONS, place)))


def may_tell(lower: Column) -> Column:
    """Whether a text in lower case holds any word without which it has no rating, action or price."""
    words = ["评级", "rating", *RATING_LEADS, *ACTIONS, "目标价", "target price", "tp", "pt", "当前股价", "现价", "current price"]
    return contains_any(lower, words)


def _one_line(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def target_price(text: Column) -> Column:
    after = rf"(?i){_TARGET_LABEL}[^0-9人民币港元美元新元]{{0,16}}(?:为|至|:|：)?{SPACE}*(人民币{SPACE}*)?({_PRICE})"
    before = rf"(?i)((?:人民币{SPACE}*)?{_PRICE})[^。\n]{{0,12}}{_TARGET_LABEL}"
    labelled = F.when(found(text, after, 2).isNotNull(), F.concat(F.regexp_extract(text, after, 1), F.regexp_extract(text, after, 2)))
    return F.when(contains_any(F.lower(text), ["目标价", "target price", "tp", "pt"]), _one_line(F.coalesce(labelled, found(text, before))))


def current_price(text: Column) -> Column:
    direct = found(text, rf"(?i){_CURRENT_LABEL}[^\n:：]{{0,60}}[:：]{SPACE}*{_SPOT}")
    line = F.get(F.filter(F.split(text, r"\r?\n", -1), lambda x: x.rlike(f"(?i){_CURRENT_LABEL}")), F.lit(0))
    last = F.try_element_at(F.regexp_extract_all(line, F.lit(_SPOT), F.lit(1)), F.lit(-1))
    return F.when(contains_any(F.lower(text), ["当前股价", "现价", "current price"]), _one_line(F.coalesce(direct, last)))


def signal_type(norm_line: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(norm_line, words), F.lit(kind)) for kind, words in SIGNALS.items()])


def signal_label(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SIGNAL_LABELS.items()])


def clean_name(raw: Column) -> Column:
    """The name proper of what stands before a parenthesis; the order of steps matters."""
    name = F.element_at(F.split(raw, " - ", -1), -1)
    name = F.regexp_replace(name, "^#+", "")
    name = F.regexp_replace(name, "[=*_`]", "")
    name = F.regexp_replace(name, NAME_LEADS, "")
    name = trim(F.regexp_replace(name, NAME_TAILS, ""))
    short = f"^([{HAN}A-Za-z0-9]{{2,12}})"
    return _within(name, lambda x: F.coalesce(*[found(x, f"{short}(?:{after})") for after in NAME_FOLLOWERS], x))


def is_noise(norm_name: Column) -> Column:
    return (F.length(norm_name) < 2) | norm_name.isin(*NOISE_NAMES) | contains_any(norm_name, NOISE_WORDS)


def sentiment_counts(excerpt: Column) -> tuple[Column, Column]:
    return F.count_if(any_word(excerpt, POSITIVE)), F.count_if(any_word(excerpt, NEGATIVE))


def sentiment_hint(positive: Column, negative: Column) -> Column:
    return F.when(positive >= negative, "偏积极或建设性").otherwise("风险提示较多")


def parse_rating_query(query: str | None, mode: str | None = None) -> str | None:
    """The rating a query asks for, ``*`` for any, null for a plain search."""
    text = re.sub("评级|投资评级|rating", "", normalize_literal(query or ""))
    if not text and mode == "rating":
        return "*"
    return next((r for r, aliases in RATING_ALIASES.items() if any(a in text for a in aliases)), None)


def rating_matches(value: Column, wanted: str) -> Column:
    if wanted == "*":
        return value.isNotNull() & (value != "")
    return value.isNotNull() & (value != "") & contains_any(tidy(value), RATING_ALIASES.get(wanted, [wanted]))


def target_key(code: Column, name: Column, alias: Column) -> Column:
    """Before normalisation."""
    blank = F.lit("")
    return F.coalesce(F.nullif(code, blank), F.nullif(name, blank), F.nullif(alias, blank), blank)
