"""Strings, names, dates and parsed values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweft.functions import vocab as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _first(pairs: list[tuple[Column, object]]) -> Column:
    """Value of the first condition that holds, else null."""
    return F.coalesce(*[F.when(cond, value if isinstance(value, Column) else F.lit(value)) for cond, value in pairs])


#: A token of lower-case text.
TOKEN = r"[a-z0-9]+|[一-鿿]{2,}"


def tokens(text: Column) -> Column:
    """lower-case runs of a-z0-9, and of two CJK characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_hash(token: Column) -> Column:
    """The first eight bytes of md5, big-endian, as a signed bit pattern."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def employment_reason(title: Column, tags: Column) -> Column:
    """Why a posting is an internship or part-time job; null if it is neither. Title comes before tags."""
    title, tags = F.coalesce(title, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")
    return _first([(title.contains("实习") | title.rlike(V.INTERN), "intern"), (title.contains("兼职") | title.rlike(V.PART_TIME), "part-time"), (tags.rlike(V.INTERN), "intern"), (tags.rlike(V.PART_TIME), "part-time")])


def invalid_job_reason(title: Column) -> Column:
    """A title without a position word that lists stacks or recruits in bulk."""
    bulk = (F.regexp_count(title, F.lit(V.STACK_SEPARATOR)) >= 2) | title.rlike(V.RECRUIT_SPAM)
    return F.when((F.coalesce(title, F.lit("")) != "") & ~title.rlike(V.POSITION_WORDS) & bulk, F.lit("aggregated"))


def joined_length(*fields: Column) -> Column:
    """Characters of the non-empty fields joined by spaces."""
    return F.length(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))


def fingerprint(source: Column, *ids: Column) -> Column:
    """C4: SHA-256 of ``source:id`` with the first non-empty id."""
    return F.sha2(F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(*[F.nullif(i, F.lit("")) for i in ids], F.lit(""))).cast("binary"), 256)


def desensitised(text: Column) -> Column:
    """Id cards, phones and mail addresses as labels, in that order."""
    for pattern, label in ((V.ID_CARD, "ID_CARD"), (V.PHONE, "PHONE"), (V.EMAIL, "EMAIL")):
        text = F.regexp_replace(text, pattern, f"[{label}]")
    return text


def _label(i: Column, kind: str) -> Column:
    return F.when(i == 0, F.lit(f"[{kind}]")).otherwise(F.concat(F.lit(f"[{kind}_"), (i + 1).cast("string"), F.lit("]")))


def _labelled(parts: Column, kind: str) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, _label(i, kind))).otherwise(p)), "")


def _originals(hits: Column, kind: str) -> Column:
    return F.map_from_entries(F.transform(hits, lambda h, i: F.struct(_label(i, kind), h)))


def masked(text: Column, surnames: str = "") -> tuple[Column, Column]:
    """Text with numbered placeholders, and the map from placeholder to original.

    The first hit of a kind is ``[X]``, the n-th ``[X_n]``. Names are a surname and one or two more characters that no
    other CJK character touches; without ``surnames`` they are left alone.
    """
    kinds = [("ID_CARD", V.ID_CARD), ("PHONE", V.PHONE), ("EMAIL", V.EMAIL)]
    if surnames:
        kinds.append(("NAME", rf"(?<![一-鿿])[{surnames}][一-鿿]{{1,2}}(?![一-鿿])"))
    maps = []
    for kind, pattern in kinds:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.split(text, pattern)
        text = _labelled(parts, kind)
        maps.append(_originals(hits, kind))
    return text, F.map_concat(*maps)


def restored(text: Column, originals: Column) -> Column:
    """Placeholders of ``masked`` put back."""
    return F.aggregate(F.map_entries(originals), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def quality(fields: dict[str, Column]) -> Column:
    """Struct of completeness, length, keyword and format scores and their weighted score, unrounded.

    ``fields``: title, company, location, salary, description, requirements and raw_text, those that there are.
    """
    six = [fields.get(k, F.lit(None).cast("string")) for k in ("title", "company", "location", "salary", "description", "requirements")]
    filled = reduce(lambda a, b: a + b, [F.when(blank_to_null(f).isNotNull(), 1).otherwise(0) for f in six])
    text = F.concat_ws(" ", *[F.nullif(fields[k], F.lit("")) for k in ("title", "description", "requirements", "raw_text") if k in fields])
    hits = reduce(lambda a, b: a + b, [F.when(text.contains(w), 1).otherwise(0) for w in V.CORE_KEYWORDS])
    complete, length, words = filled / F.lit(6.0), F.least(F.length(text) / F.lit(200.0), F.lit(1.0)), F.least(hits / F.lit(3.0), F.lit(1.0))
    form = F.when(text.rlike(V.BAD_FORMAT), 0.5).otherwise(1.0)
    return F.struct(complete.alias("completeness"), length.alias("length_score"), words.alias("keyword_score"), form.alias("format_score"), (complete * 0.4 + length * 0.3 + words * 0.2 + form * 0.1).alias("score"))


def loose_date(text: Column) -> Column:
    """The date at the beginning of a text, in one of four forms; null if there is none."""
    head = F.substring(text, 1, 10)
    return F.coalesce(*[F.try_to_date(head, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")], F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def publish_date(post_date: Column, crawled_at: Column) -> Column:
    """the posting's own date, else that of the crawl."""
    return F.coalesce(loose_date(post_date), loose_date(crawled_at))


def decay_weight(published: Column, as_of: Column) -> Column:
    """1 up to 30 days and for unknown dates, then an exponential decay."""
    days = F.datediff(as_of, published)
    return F.when(published.isNull() | (days <= 30), 1.0).otherwise(F.exp((days - 30) * -0.01))


def instant(text: Column) -> Column:
    """an ISO timestamp; ``Z`` and none mean UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def document_text(description: Column, requirements: Column, raw_text: Column, *others: Column) -> Column:
    """Raw text if description and requirements are blank, else the non-blank fields by line."""
    blank = blank_to_null(description).isNull() & blank_to_null(requirements).isNull()
    return F.when(blank, raw_text).otherwise(F.concat_ws("\n", *[blank_to_null(c) for c in (*others, description, requirements)]))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")


def skill_alias(raw: Column, aliases: dict[str, str] | None = None, whitelist: tuple[str, ...] | None = None) -> Column:
    """trimmed; an alias as it stands or in lower case; else the whitelist's spelling; else as it is."""
    aliases, whitelist = V.SKILL_ALIASES if aliases is None else aliases, V.SKILL_WHITELIST if whitelist is None else whitelist
    t, other, standard = F.regexp_replace(raw, r"^\s+|\s+$", ""), _map(aliases), _map({w.lower(): w for w in whitelist})
    return F.coalesce(F.try_element_at(other, t), F.try_element_at(other, F.lower(t)), F.try_element_at(standard, F.lower(t)), t)


def clean_skill(name: Column) -> Column:
    """one suffix goes, the longest; soft skills stay."""
    return F.when(name.isin(*V.SOFT_SKILLS), name).otherwise(F.trim(F.regexp_replace(name, f"({'|'.join(sorted(V.SKILL_SUFFIXES, key=len, reverse=True))})$", "")))


def canonical_skill(raw: Column) -> Column:
    """F6."""
    return F.lower(F.trim(clean_skill(skill_alias(raw))))


def valid_skill(name: Column) -> Column:
    """no stop word, and two characters or on the whitelist."""
    return ~name.isin(*V.SKILL_STOPWORDS) & ((F.length(name) >= 2) | name.isin(*V.SKILL_WHITELIST))


def noise(name: Column) -> Column:
    """generic words, stop words, numbers, compounds, and names of positions or of experience; aliases' standard names never are."""
    patterns = reduce(lambda a, b: a | b, [name.rlike(p) for p in (V.COMPOUND_NOISE, V.POSITION_NOISE, V.EXPERIENCE_NOISE)])
    return F.when(name.isin(*V.GENERIC_NOISE, *V.SKILL_STOPWORDS), True).when(name.isin(*set(V.SKILL_ALIASES.values())), False).otherwise((F.length(name) < 2) | name.rlike(r"^\p{Nd}+$") | patterns)


def rule_skills(text: Column, whitelist: tuple[str, ...] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """sorted standard names whose name or alias the lower-cased text holds."""
    low, names, other = F.lower(text), V.SKILL_WHITELIST if whitelist is None else whitelist, V.SKILL_ALIASES if aliases is None else aliases
    terms = list(dict.fromkeys([(w.lower(), w) for w in names] + [(k.lower(), v) for k, v in other.items()]))
    held = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in terms]), lambda x: low.contains(x["t"]))
    return F.array_sort(F.array_distinct(F.transform(held, lambda x: x["v"])))


def proficiency(text: Column) -> Column:
    """F10."""
    return F.when(F.trim(text).isin("初级", "中级", "高级"), F.trim(text)).otherwise(_first([(_any(text, words), level) for words, level in V.PROFICIENCY]))


def education_rank(text: Column) -> Column:
    """the first word that is found decides."""
    return _first([(text.contains(w), n) for w, n in V.EDUCATION])


def education_score(required: Column, candidate: Column) -> Column:
    """1 at or above the required rank, 0.5 one below, else 0; null if either is unknown."""
    r, c = education_rank(required), education_rank(candidate)
    return F.when(r.isNull() | c.isNull(), F.lit(None).cast("double")).when(c >= r, 1.0).when(c == r - 1, 0.5).otherwise(0.0)


def monthly_salary(raw: Column, source: Column) -> Column:
    """middle of a salary text in CNY a month; null if it can't be read. ``k`` means thousands in every currency."""
    return let(F.regexp_replace(F.trim(raw), ",", ""), lambda text: _monthly(text, source))


def _monthly(text: Column, source: Column) -> Column:
    sep, num = "(?:-|~|至)", r"([\d.]+)"
    amount = r"(\d+(?:\.\d+)?)"

    def mid(pattern: str, factor: float) -> Column:
        low, high = (F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("double") for g in (1, 2))
        return (low + high) / 2 * factor

    def one(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")

    year, hour = V.USD_RATE / 12, 8 * V.DAYS_PER_MONTH * V.USD_RATE
    up_to = one(rf"(?i)up to\s*\$?{amount}\s*k")
    dollar = text.rlike(rf"(?i)up to\s*\${amount}\s*k") | F.coalesce(source, F.lit("")).isin(*V.INTERNATIONAL_SOURCES)
    return F.round(
        F.coalesce(
            mid(rf"{num}\s*{sep}\s*{num}\s*万", 10000.0),
            mid(rf"(?i){num}\s*{sep}\s*{num}\s*K\b", 1000.0),
            mid(rf"{num}\s*{sep}\s*{num}\s*元/天", float(V.DAYS_PER_MONTH)),
            mid(rf"(?i)USD\s*\$?{amount}\s*{sep}\s*\$?{amount}", year),
            mid(rf"(?i){amount}\s*{sep}\s*\$?{amount}\s*/\s*year", year),
            F.when(dollar, up_to * 1000.0 * year).otherwise(up_to * 1000.0),
            one(rf"(?i)up to\s*\$\s*{amount}\s*k") * 1000.0 * year,
            one(r"(?i)up to\s*\$?([\d.]+)\s*/hour") * hour,
            one(rf"(?i)\$\s*{amount}\s*/hour") * hour,
        ),
        2,
    )


def min_years(text: Column) -> Column:
    """the first integer."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def experience_range(text: Column) -> Column:
    """struct of the least and most years; an open end is null."""
    pair = r"(\d+)\s*(?:-|~|至)\s*(\d+)\s*年"
    get = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(get(pair, 1), get(r"(\d+)\s*年以上", 1), F.when(text.contains("不限"), 0)).alias("min"), get(pair, 2).alias("max"))


def duration_hours(text: Column) -> Column:
    """hours of a duration by its unit, in Chinese or English."""
    low = F.lower(F.trim(text))
    pattern = r"(\d+(?:\.\d+)?)\s*(?:个)?([a-z一-鿿]+)"
    n, unit = F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("double"), F.regexp_extract(low, pattern, 2)
    return F.round(n * _first([(unit.startswith(u), h) for u, h in V.UNIT_HOURS]), 1)


def week_key(ts: Column) -> Column:
    """ISO week ``YYYY-Www``."""
    return F.when(ts.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)))


def week_key_of_text(text: Column) -> Column:
    """of an ISO text; the first ten characters if it can't be read."""
    return F.coalesce(week_key(F.try_to_timestamp(text)), F.substring(text, 1, 10))


def token_estimate(text: Column) -> Column:
    """CJK characters and a quarter of the others, rounded up."""
    cjk = F.regexp_count(text, F.lit(r"[一-鿿]"))
    return cjk + F.ceil((F.length(text) - cjk) / 4)


def fulltext_query(q: Column) -> Column:
    """without characters that mean something to a full-text parser."""
    return F.trim(F.regexp_replace(q, r'[+\-&|!(){}\[\]^"~*?:\\/]', " "))


def stable_id(prefix: str, name: Column) -> Column:
    """F30."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(name.cast("binary")), 1, 8))


def contains_name(new: Column, old: Column) -> Column:
    """F32: one name holds the other and is longer by two characters or more."""
    return (new.contains(old) | old.contains(new)) & (F.abs(F.length(new) - F.length(old)) >= 2)


def bigrams(name: Column) -> Column:
    """F32: distinct pairs of characters."""
    return F.when(F.length(name) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def shared_bigrams(a: Column, b: Column) -> Column:
    """F32."""
    return F.size(F.array_intersect(bigrams(a), bigrams(b)))


def split_skills(text: Column) -> Column:
    """A comma-separated list, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def summary_text(position: Column, matched: Column, missing: Column) -> Column:
    """The first five matched and missing skills in words."""
    return F.concat_ws("；", position, F.concat(F.lit("匹配 "), F.array_join(F.slice(matched, 1, 5), "、")), F.when(F.size(missing) > 0, F.concat(F.lit("缺口 "), F.array_join(F.slice(missing, 1, 5), "、"))))
