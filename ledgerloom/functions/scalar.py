"""Scalar expressions that several operators share. All literals are doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: C) -> Column:
    """Rounded to six decimals, without a negative zero: what is compared between engines.

    The small shift keeps means of amounts, which end in exact halves, off the edge where sums in another order differ.
    """
    return F.round(col(x) + F.lit(3e-9), 6) + F.lit(0.0)


def safe_ratio(n: C, d: C) -> Column:
    return col(n) / (col(d) + F.lit(1.0))


def clamped_ratio(n: C, d: C) -> Column:
    return col(n) / F.greatest(col(d).cast("double"), F.lit(1.0))


def finite_or(x: C, fill: float = 0.0) -> Column:
    """x, or fill where it is null, NaN or infinite."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(fill)).otherwise(x)


def clean(x: C) -> Column:
    """A raw value with the sentinel -1 for what is missing."""
    return finite_or(col(x).cast("double"), -1.0)


def missing(x: C) -> Column:
    return (col(x) == F.lit(-1.0)).cast("double")


def total(columns: Sequence[C]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + col(c)
    return out


def normalized_entropy(counts: Sequence[C]) -> Column:
    """Entropy of a count vector over the logarithm of its length (two at least); 0 for no counts."""
    n = total(counts)
    p = [F.when(n > 0, col(c) / F.greatest(n, F.lit(1.0))).otherwise(F.lit(0.0)) for c in counts]
    h = total([-x * F.ln(F.greatest(x, F.lit(1e-6))) for x in p])
    return h / F.ln(F.lit(float(max(len(counts), 2))))


def top_share(counts: Sequence[C], k: int) -> Column:
    """The share of the k largest counts in all, over one at least."""
    k = max(1, min(k, len(counts)))
    ordered = F.slice(F.sort_array(F.array(*[col(c).cast("double") for c in counts]), asc=False), 1, k)
    return F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / F.greatest(total(counts), F.lit(1.0))


def coverage(counts: Sequence[C]) -> Column:
    return total([(col(c) > 0).cast("double") for c in counts]) / F.lit(float(len(counts)))


def sigmoid(x: C) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def log_loss(y: C, p: C, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))
    return -(col(y) * F.ln(q) + (F.lit(1.0) - col(y)) * F.ln(F.lit(1.0) - q))


def relative_time(day: C, snapshot: C, max_day: float) -> Column:
    return F.least(F.greatest((col(snapshot) - col(day)) / F.lit(max(float(max_day), 1.0)), F.lit(0.0)), F.lit(1.0))


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def stable_bucket(text: C, n: int) -> Column:
    """The first 12 hex digits of a text's SHA-256, modulo n."""
    return (F.conv(F.substring(F.sha2(col(text), 256), 1, 12), 16, 10).cast("long") % n).cast("long")


def percent_with_delta(value: C, delta: C) -> Column:
    return F.format_string("%.2f%% (%+.2f%%)", col(value) * 100.0, col(delta) * 100.0)


def binary_label(raw: C) -> Column:
    """`1` is fraud, `2` normal, all else unknown; case and outer white space don't count."""
    x = F.lower(F.trim(col(raw).cast("string")))
    return F.when(x == "1", F.lit(1)).when(x == "2", F.lit(0)).otherwise(F.lit(-100))


def risk_tier(score: C, label: C) -> Column:
    return F.when((col(label) == "suspicious") | (col(score) >= 0.75), "suspicious").when(col(score) < 0.35, "no_risk").otherwise("low_risk")


def half_life_weight(age: C, half_life: float, floor: float = 0.0) -> Column:
    return F.greatest(F.pow(F.lit(0.5), col(age) / F.lit(half_life)), F.lit(floor))


def time_weight(age: C, rate: float) -> Column:
    return F.exp(-F.lit(rate) * col(age))


def class_target(y: C, classes: int) -> Column:
    """Labels as targets of 2, 3 or 4 classes; -1 for those without one."""
    y = col(y)
    out = F.when(y.isin(0, 1), y)
    if classes == 3:
        out = out.when(y.isin(2, 3), F.lit(2))
    elif classes == 4:
        out = out.when(y.isin(2, 3), y)
    return out.otherwise(F.lit(-1))


def blended(p: Sequence[C], weights: Sequence[float]) -> Column:
    return total([col(x) * F.lit(w / sum(weights)) for x, w in zip(p, weights, strict=True)])


def without_background(p_normal: C, p_fraud: C) -> Column:
    return col(p_fraud) / F.greatest(col(p_normal) + col(p_fraud), F.lit(1e-12))


def time_position(bucket: C, buckets: int) -> Column:
    """A bucket's place between 0 and 1."""
    return col(bucket).cast("double") / F.lit(float(max(buckets - 1, 1)))


def one_hot(code: C, codes: int) -> list[Column]:
    return [(col(code) == F.lit(i)).cast("double") for i in range(codes)]


def cold_prior(support: C) -> Column:
    """How little is known of something that was seen so often."""
    return F.lit(1.0) / (F.lit(1.0) + col(support))


def risk_scale(parts: Sequence[C], weights: Sequence[float], strength: float) -> Column:
    """A message's factor around 1: the sigmoid of a weighted sum, less one half, times the strength."""
    return F.lit(1.0) + F.lit(strength) * (sigmoid(total([col(p) * F.lit(w) for p, w in zip(parts, weights, strict=True)])) - F.lit(0.5))


def trailing_digits(text: C) -> Column:
    """The digits at the end of a text as a number, null without any."""
    return F.nullif(F.regexp_extract(col(text), r"(\d+)$", 1), F.lit("")).cast("long")


def has_cjk(text: C) -> Column:
    """Whether a text has a character of the unified CJK ideographs."""
    return col(text).rlike("[\\x{4e00}-\\x{9fff}]")


def object_id(position: C, owner: C) -> Column:
    """P-dddd-nnnnnn: an owner's number and a position in it."""
    return F.format_string("P-%04d-%06d", col(owner).cast("long"), col(position).cast("long"))


def expired(created: C, now: C, minutes: int) -> Column:
    """Whether so many minutes have passed since a timestamp."""
    return col(created) + F.expr(f"INTERVAL {minutes} MINUTES") <= col(now)


# What columns are called by number, and by the first group of words of which one is in the name.
NUMBERED_NAMES = ("近期交易活跃度", "交易金额波动", "邻域风险关联", "资金流入流出偏移", "交易时间规律", "账户行为稳定性", "跨区域流转强度", "对手方集中度", "短期交易频次变化", "资金链路深度", "账户画像偏移", "历史行为一致性", "社群关联密度", "异常金额占比", "短期行为突增", "风险邻居暴露")
NAMES_BY_WORD = (
    (("amount", "amt", "value", "money", "balance"), "交易金额特征"),
    (("count", "freq", "frequency", "degree", "num"), "交易频次特征"),
    (("time", "hour", "day", "window", "period"), "时间行为特征"),
    (("region", "city", "area", "geo"), "地域流转特征"),
    (("neighbor", "edge", "graph", "relation"), "关系网络特征"),
    (("in", "out", "flow"), "资金流向特征"),
    (("risk", "fraud", "label"), "历史风险特征"),
    (("device", "ip", "account"), "账户环境特征"),
)
OTHER_NAME = "业务行为特征"


def shown_name(name: C) -> Column:
    """What a column is called for users: numbered features by the last number in the name, names with Chinese characters as they are, others by a word in them."""
    text, lower = F.trim(col(name)), F.lower(F.trim(col(name)))
    digits = F.nullif(F.regexp_extract(lower, r"(\d+)\D*$", 1), F.lit(""))
    at = F.pmod(digits.cast("decimal(38,0)"), F.lit(len(NUMBERED_NAMES))).cast("int")
    numbered = (F.startswith(lower, F.lit("feature_")) | F.startswith(lower, F.lit("core_feature_"))) & digits.isNotNull()
    out = F.when(numbered, F.get(F.array(*[F.lit(x) for x in NUMBERED_NAMES]), at)).when(has_cjk(text), text)
    for words, shown in NAMES_BY_WORD:
        out = out.when(lower.rlike("|".join(words)), shown)
    return out.otherwise(OTHER_NAME)
