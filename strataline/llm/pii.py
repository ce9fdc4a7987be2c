"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

All of it is Spark SQL expressions over each row's own text: no shuffle, no Python on the executors.

Positions come from two built-ins that walk the same matches: ``regexp_extract_all`` gives the matched pieces and
``split`` the pieces between them, so a running sum of their lengths gives code-point offsets. The patterns are
possessive, so that runs of thousands of digits or letters neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The kinds whose matches are reported whatever their score, in the order of equal starts, then the kinds added.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "localphone")

#: A local part may start inside a run of its characters only where the match before it has ended; hence \G.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # shorter runs can't hold the 12 digits that the validator asks for
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # only the start: capitals or digits of the next words look like the account's own, so that its end is sought apart
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "localphone": r"(?<![0-9+.-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])",
}
#: All that can belong to an account number: 34 signs, a space before each from the fifth on.
ACCOUNT, ACCOUNT_LEAST, ACCOUNT_MOST = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 15, 34
#: What a text must contain for the pattern to be tried at all.
HINTS = {"email": "@", "phone": "+", "localphone": "("}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "localphone": 0.4}
CUES = {
    "email": "mail|contact|write to",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "tel|phone|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "localphone": "tel|phone|call|mobile|fax",
}
CUE_GAIN = 0.15
#: Code points looked at before a span, and the least score of an added span.
NEAR, LEAST = 32, 0.5
#: Code points of the pieces that texts are cut into.
CHUNK = 1024

_FOUND = "array<struct<start:bigint,end:bigint,found:string>>"


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, not again for each element of what body maps over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def _running(values: Column, join, zero: Column) -> Column:
    """What join makes of all values before each one. In blocks of about the root of their number, as arrays can't grow in place."""

    def whole(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(_upto(F.ceil(F.size(v) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

        def of(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, zero, join))
            return _bound(sums, lambda t: F.flatten(F.transform(parts, lambda p, b: _within(p, F.aggregate(F.slice(t, F.lit(1), b), zero, join)))))

        def _within(p: Column, before: Column) -> Column:
            return _bound(before, lambda x: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), x, join)))

        return _bound(blocks, of)

    return _bound(values, whole)


def _added(acc: Column, x: Column) -> Column:
    return acc + x


def _chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, so that a part of it is found without walking from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """length code points from start (0 is the first)."""
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor((start + length) / CHUNK).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(chunks, first + 1, many), ""), (start - first * CHUNK + 1).cast("int"), length.cast("int"))


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """Where the matches stand: each begins after all matches and pieces before it and its own piece."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(matches, lambda m: F.length(m).cast("long"))

    def spans(g: Column) -> Column:
        before = _running(F.zip_with(g, sizes, lambda x, y: x + F.coalesce(y, F.lit(0))), _added, F.lit(0).cast("long"))
        starts = F.zip_with(g, before, lambda x, y: x + y)
        found = F.zip_with(starts, matches, lambda x, m: F.struct(x.alias("start"), (x + F.length(m)).cast("long").alias("end"), m.alias("found")))
        return F.filter(found, lambda s: s["found"].isNotNull()).cast(_FOUND)

    return _bound(gaps, spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""

    def step(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return (total + F.when(i % 2 == 1, twice).otherwise(x)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters count 10 to 35, the first four signs moved to the end) leaves 1 over 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return (F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _accounts(chunks: Column, starts: Column) -> Column:
    """Spans of account numbers: from each start the longest run of 15 to 34 signs that ends a word and has right check digits.

    Of spans that overlap the first stays.
    """

    def longest(s: Column) -> Column:
        ahead = _part(chunks, s["start"], F.lit(2 * ACCOUNT_MOST - 4 + 1))
        run = F.regexp_extract(ahead, ACCOUNT, 0)

        def fits(e: Column) -> Column:
            packed = F.regexp_replace(F.substr(run, F.lit(1), e), " ", "")
            ends_word = (F.substr(run, e, F.lit(1)) != " ") & ~F.substr(ahead, e + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            return F.when(ends_word & F.length(packed).between(ACCOUNT_LEAST, ACCOUNT_MOST), mod97(packed)).otherwise(False)

        end = F.get(F.filter(F.sequence(F.length(run), F.lit(ACCOUNT_LEAST), F.lit(-1)), fits), F.lit(0))
        return F.struct(s["start"].alias("start"), (s["start"] + end).alias("end"), F.substr(run, F.lit(1), end).alias("found"))

    whole = F.filter(F.transform(starts, longest).cast(_FOUND), lambda s: s["end"].isNotNull())

    def first_ones(spans: Column) -> Column:
        # an account is at most 64 code points long, so that a chain of overlaps is followed among few
        keep = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.lit("1")).alias("out"))).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], F.lit("0")).alias("out"))))["out"]
        return _bound(F.split(keep, ""), lambda k: F.filter(spans, lambda s, i: F.get(k, i) == "1"))

    return _bound(whole, first_ones)


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        # leading zeros say nothing about the part's value
        parts = F.split(F.regexp_replace(found, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _confirmed(kind: str):
    return lambda s: _valid(kind, s["found"])


def _scored(kind: str, chunks: Column):
    def dressed(s: Column) -> Column:
        before = F.lower(_part(chunks, F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["start"], F.lit(NEAR))))
        score = F.lit(PRIOR[kind]) + F.when(before.rlike(CUES[kind]), CUE_GAIN).otherwise(0.0)
        rank = (BASE + ADDED).index(kind)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"), score.alias("score"), s["found"].alias("found"))

    return dressed


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with a column out_col: every span of personal data, ordered by start and kind.

    A span is struct<kind, start, end, base, score, found>; start and end count code points, end is exclusive. Kinds
    of BASE are kept whatever their score; those of ADDED only from a score of LEAST, which a local phone number
    reaches by a cue word within NEAR code points before it.

    Null text: no spans (an empty array), as for empty text. Repeated rows are handled one by one. A column named
    out_col is replaced; all others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = BASE + ADDED
    whole, pieces, *found = fresh(docs, "pii_text", "pii_pieces", *(f"pii_{k}" for k in kinds))
    df = docs.withColumn(whole, text).withColumn(pieces, _chunks(F.col(whole)))
    df = df.withColumns({c: (F.when(F.contains(F.col(whole), F.lit(HINTS[k])), x).otherwise(F.array().cast("array<string>")) if k in HINTS else x) for k, c in zip(kinds, found) for x in [F.regexp_extract_all(F.col(whole), F.lit(PATTERNS[k]), F.lit(0))]})
    per_kind = []
    for k, c in zip(kinds, found):
        located = _located(F.col(whole), F.col(c), PATTERNS[k])
        confirmed = _accounts(F.col(pieces), located) if k == "iban" else F.filter(located, _confirmed(k))
        spans = F.transform(confirmed, _scored(k, F.col(pieces)))
        kind_type = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,score:double,found:string>>"
        per_kind.append(F.when(F.size(F.col(c)) > 0, spans.cast(kind_type)).otherwise(F.array().cast(kind_type)))
    every = F.filter(F.array_sort(F.concat(*per_kind)), lambda s: s["base"] | (s["score"] >= LEAST))
    final = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score"), s["found"].alias("found")))
    return df.withColumn(out_col, final).drop(whole, pieces, *found)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by ``<kind>``; where spans overlap, the first one's name stands for their union.

    Columns stay as they are but for the text (and n_chars, where there is one). Null texts stay null.
    """
    (spans,) = fresh(docs, "pii_spans")
    df = find_pii(docs, text_col, spans)
    text = F.col(text_col)

    def masked_from(chunks: Column) -> Column:
        # how far the spans before each one reach; what overlaps them has no name of its own
        reach = _running(F.transform(F.col(spans), lambda s: s["end"].cast("long")), lambda acc, x: F.greatest(acc, x), F.lit(0).cast("long"))
        named = F.zip_with(F.col(spans), reach, lambda s, r: F.when(s["start"] >= r, F.concat(_part(chunks, r, s["start"] - r), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        last = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))
        return F.concat(F.array_join(named, ""), F.substr(text, (last + 1).cast("int")))

    masked = _bound(_chunks(text), masked_from)
    df = df.withColumn(text_col, F.when(F.size(F.col(spans)) > 0, masked).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(F.col(spans)) > 0, F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts and the digest of base spans, all spans as text."""
    (spans,) = fresh(docs, "pii_spans")
    df = find_pii(docs.select("doc_id", "text"), "text", spans)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined(F.filter(F.col(spans), lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def _sql_kind(kind: str, rank: int, pattern: str, valid: str) -> str:
    return f"""
    SELECT doc_id, rid, '{kind}' AS kind, {rank} AS rank, (before - strlen_found)::BIGINT AS s, before::BIGINT AS e, found FROM (
      SELECT doc_id, rid, found, length(found) AS strlen_found,
             sum(length(gap) + length(found)) OVER (PARTITION BY rid ORDER BY i) AS before
      FROM (SELECT doc_id, rid, unnest(m) AS found, unnest(string_split_regex(t, '{pattern}')[1:len(m)]) AS gap, unnest(range(len(m))) AS i
            FROM (SELECT doc_id, rid, t, regexp_extract_all(t, '{pattern}') AS m FROM d) WHERE len(m) > 0))
    WHERE {valid}"""


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    digits = "regexp_replace(found, '[^0-9]', '', 'g')"
    luhn_sql = f"(SELECT sum(CASE WHEN i % 2 = 0 THEN x ELSE CASE WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END END) % 10 = 0 FROM (SELECT i, substr(reverse({digits}), i::BIGINT + 1, 1)::INT AS x FROM range(length({digits})) r(i)))"
    packed = "replace(found, ' ', '')"
    mod = f"list_reduce(list_transform(string_split(substr({packed}, 5) || substr({packed}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::BIGINT ELSE c::BIGINT END), lambda r, v: CASE WHEN v >= 10 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"
    kinds = [
        _sql_kind("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_kind("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(found, '.'), lambda p: p::HUGEINT)) <= 255"),
        _sql_kind("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sql}"),
        _sql_kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        _sql_kind("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", f"length({packed}) BETWEEN 15 AND 34 AND {mod}"),
        _sql_kind("localphone", 5, r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}\b", "true"),
    ]
    cues = " OR ".join(f"regexp_matches(near, '{w}')" for w in [CUES["localphone"]])
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
    every AS ({' UNION ALL '.join(kinds)}),
    near AS (SELECT every.*, lower(substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR}))) AS near, substr(t, s, 1) AS prev FROM every JOIN d USING (rid)),
    good AS (SELECT * FROM near WHERE rank < 5 OR (({cues}) AND (s = 0 OR NOT regexp_matches(prev, '[0-9+.-]')))),
    per AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
                   count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS b,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM good GROUP BY rid)
    SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
           coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN per USING (rid)"""
