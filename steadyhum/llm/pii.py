"""Personal data: four base patterns, and contexts learned from them that find further identifiers.

Base spans (email, ip, card, phone) are found by regular expressions in every whole text. The
expressions are the contract's, written so that each is linear in the text: a match can only
begin where its run of characters begins or where the last match ended, and runs are possessive.

Bootstrapping then learns from the corpus itself. The values of the base spans are seeds. The
two words before a value are its lexical pattern, read from the text whatever was matched in it;
a value that only punctuation separates from the one before belongs to a list and takes the
pattern of the list. Seeds and candidates (tokens of six or more letters, digits, ``_`` and
``-``, one a digit, outside the base spans) form a bipartite graph of patterns and values. A
pattern's confidence in a kind is the share of its values that belong to it, a value's score is
that of its best pattern, and a value whose score reaches ``min_score`` counts as a seed for all
its other patterns, so patterns without base seeds can follow. Patterns with fewer than
``min_support`` seeds of a kind tell nothing. The scores rise round by round to their fixed point
(no confidence changes by more than ``CHANGE``, at most ``MAX_ROUNDS`` rounds). Candidates under
a pattern whose confidence reaches ``min_score`` become spans of kind ``identifier``. Base spans
are never changed by this.

Everything is DataFrame expressions. Scanning is row-local; only pairs of context and value,
combined map-side, and the rows of discovered spans are shuffled.

Defined results: a null text counts as empty and has no spans; spans are in code points, the end
exclusive, ordered by start, then kind as listed in ``KINDS``; rows that repeat id and text get
the same spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import bounded_join, materialize
from .common import texts, unused

KINDS = ("email", "ip", "card", "phone", "identifier")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
BLOCK = 256
MAX_ROUNDS = 100
CHANGE = 1e-6
MIN_SCORE = 0.8
MIN_SUPPORT = 5
CONTEXT_CHARS = 64


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The check that a match of ``kind`` must pass to be a span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(F.lit(False))
    return n.between(9, 15)


def may_hold(kind: str, text: Column) -> Column:
    """A cheap necessary condition, so that most texts never meet the expression."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")


def located(gaps: Column, found: Column) -> Column:
    """Array of (start, end, value, before) from the texts between matches and the matches.

    ``before`` is the end of the text before the match, with whatever was matched in it. Positions
    are running sums, taken in blocks so that the work stays linear in the matches.
    """
    item = "array<struct<start:int,end:int,value:string,before:string>>"
    cut = lambda c: F.right(c, F.lit(CONTEXT_CHARS))

    def taken(first: Column, n: Column, made) -> Column:
        return F.zip_with(F.slice(gaps, first + 1, n), F.slice(found, first + 1, n), made)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = cut(F.concat(acc["tail"], cut(x["gap"])))
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))
        return F.struct(
            end.alias("at"),
            cut(F.concat(before, cut(x["value"]))).alias("tail"),
            F.concat(acc["spans"], F.array(span)).alias("spans"),
        )

    def block(b: Column) -> Column:
        first = b * BLOCK
        near = F.lit(CONTEXT_CHARS // 2)  # no match is shorter than two characters
        head = taken(first - near, near, lambda g, m: F.concat(cut(g), cut(m)))
        tail = F.when(b > 0, cut(F.array_join(head, ""))).otherwise("")
        zero = F.struct(F.lit(0).alias("at"), tail.alias("tail"), F.array().cast(item).alias("spans"))
        n = F.least(F.lit(BLOCK), F.size(found) - first)
        return F.aggregate(taken(first, n, lambda g, m: F.struct(g.alias("gap"), m.alias("value"))), zero, step)

    def whole(local: Column) -> Column:
        def shifted(x: Column, j: Column) -> Column:
            offset = F.aggregate(F.slice(local, F.lit(1), j), F.lit(0), lambda a, y: a + y["at"])
            moved = lambda o: F.transform(
                x["spans"],
                lambda s: F.struct(
                    (s["start"] + o).alias("start"),
                    (s["end"] + o).alias("end"),
                    s["value"].alias("value"),
                    s["before"].alias("before"),
                ),
            )
            return F.transform(F.array(offset), moved)[0]

        return F.flatten(F.transform(local, shifted))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    # The array keeps the blocks from being computed again for every block.
    spans = F.transform(F.array(F.transform(blocks, block)), whole)[0]
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(item))


def words(before: Column) -> Column:
    """The words of ``before`` in lower case, digits as 0, without punctuation."""
    plain = F.regexp_replace(F.lower(before), r"[0-9]", "0")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}0]+", " "))


def in_context(matches: Column) -> Column:
    """``matches``, ordered by start, with the pattern of each instead of the text before it.

    The pattern is the last two words; a match that is one of them is read as ``0``. Matches of a
    list, with no word between them, have the pattern of the first.
    """

    def own(m: Column, i: Column) -> Column:
        ended = F.greatest(*[F.get(matches, i - k)["end"] for k in (1, 2, 3, 4)])  # spans may overlap
        gap = F.greatest(m["start"] - ended, F.lit(0))
        near = ended.isNotNull() & (gap < CONTEXT_CHARS)
        last = words(F.when(near, F.right(m["before"], gap)).otherwise(m["before"]))
        two = F.regexp_extract(last, r"((?:\S+ )?\S+)$", 1)
        return (
            F.when(near & (last == ""), F.lit(None))
            .when(near & ~last.contains(" "), F.concat(F.lit("0 "), last))
            .otherwise(two)
        )

    def listed(own_patterns: Column) -> Column:
        def lists(heads: Column) -> Column:
            def members(h: Column, k: Column) -> Column:
                n = F.coalesce(F.get(heads, k + 1), F.size(matches)) - h
                return F.transform(
                    F.slice(matches, h + 1, n),
                    lambda m: F.struct(
                        m["start"].alias("start"),
                        m["rank"].alias("rank"),
                        m["end"].alias("end"),
                        m["value"].alias("value"),
                        F.get(own_patterns, h).alias("before"),
                    ),
                )

            return F.flatten(F.transform(heads, members))

        numbered = F.transform(own_patterns, lambda p, i: F.when(p.isNotNull(), i))
        return F.transform(F.array(F.array_compact(numbered)), lists)[0]

    return F.transform(F.array(F.transform(matches, own)), listed)[0]


def scan(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with array ``out`` of all matches of column ``text``: (start, rank, end, value, before).

    Matches that fail their check and candidates that touch a base span are left out.
    """
    t = F.col(text)
    names = {k: (unused(docs, f"gaps_{k}"), unused(docs, f"found_{k}")) for k in (*PATTERNS, "identifier")}
    where = {k: may_hold(k, t) for k in PATTERNS} | {"identifier": t.rlike("[0-9]")}
    pattern = PATTERNS | {"identifier": CANDIDATE}
    df = docs.withColumns(
        {f: F.when(where[k], F.regexp_extract_all(t, F.lit(pattern[k]), F.lit(0))) for k, (_, f) in names.items()}
    )
    df = df.withColumns(
        {g: F.when(F.size(F.col(f)) > 0, F.split(t, pattern[k], -1)) for k, (g, f) in names.items()}
    )
    spans = {k: unused(docs, f"spans_{k}") for k in names}
    df = df.withColumns({spans[k]: F.when(F.col(g).isNotNull(), located(F.col(g), F.col(f))) for k, (g, f) in names.items()})

    def tagged(kind: str, ok) -> Column:
        return F.transform(
            F.coalesce(F.col(spans[kind]), F.array()),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                s["before"].alias("before"),
                ok(s).alias("valid"),
            ),
        )

    base, loose = unused(docs, "base_matches"), unused(docs, "loose_matches")
    df = df.withColumn(base, F.concat(*[tagged(k, lambda s, k=k: holds(k, s["value"])) for k in PATTERNS]))
    free = lambda s: ~F.exists(
        F.col(base), lambda b: b["valid"] & (b["start"] < s["end"]) & (s["start"] < b["end"])
    )
    df = df.withColumn(loose, tagged("identifier", free))
    df = df.withColumn(
        out, F.array_sort(F.filter(F.concat(F.col(base), F.col(loose)), lambda m: m["valid"]))
    )
    df = df.withColumn(out, in_context(F.col(out)))
    return df.drop(base, loose, *spans.values(), *[c for pair in names.values() for c in pair])


def base_spans(matches: Column) -> Column:
    return F.filter(matches, lambda m: m["rank"] < len(PATTERNS))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def score_graph(edges: DataFrame, max_rounds: int, min_score: float, min_support: int) -> DataFrame:
    """Accepted (before, value) pairs of candidates, from distinct ``edges`` (before, value, rank).

    ``rank`` is the kind of a seed and that of ``identifier`` for candidates. Only patterns with
    candidates and with ``min_support`` values that are or may become seeds can tell anything, so
    the rest goes first. Confidences only rise. Values that no other pattern scores higher belong to
    a pattern as surely as it says itself, (seeds + own * c) / (degree + 1) = c, which is solved and
    not iterated, so the rounds do not grow with the number of unseen values.
    """
    kinds, loose = range(len(PATTERNS)), len(PATTERNS)
    degree = edges.groupBy("before").agg(
        F.count(F.lit(1)).alias("degree"),
        *[F.sum((F.col("rank") == r).cast("int")).alias(f"seeds_{r}") for r in kinds],
        F.sum((F.col("rank") == loose).cast("int")).alias("loose"),
    )
    most = F.greatest(*[F.col(f"seeds_{r}") for r in kinds])
    patterns = degree.where((F.col("loose") > 0) & (F.col("before") != "") & (most + F.col("loose") >= min_support))
    first = {
        f"c_{r}": F.when(
            F.col(f"seeds_{r}") >= min_support, F.col(f"seeds_{r}") / (F.col("degree") + 1 - F.col("loose"))
        ).otherwise(0.0)
        for r in kinds
    }
    sure = materialize(patterns.withColumns(first), "patterns")
    best = F.greatest(*[F.col(f"c_{r}") for r in kinds])
    row_bytes = F.octet_length("before") + 8 * len(sure.columns)
    if sure.where(best > 0).isEmpty():
        return edges.select("before", "value").limit(0)
    links = edges.where(F.col("rank") == loose).select("before", "value")
    links = materialize(links.join(sure.select("before"), "before", "left_semi"), "links")
    for _ in range(max_rounds):
        told = sure.select("before", *[f"c_{r}" for r in kinds])
        held = bounded_join(links, told, ["before"], [F.col("value")], row_bytes)
        scores = held.groupBy("value").agg(*[F.max(f"c_{r}").alias(f"s_{r}") for r in kinds])
        sums = []
        for r in kinds:
            s, higher = F.col(f"s_{r}"), F.col(f"s_{r}") > F.col(f"c_{r}")
            seed = higher & (s >= min_score)
            sums.append(F.sum(seed.cast("int")).alias(f"new_{r}"))
            sums.append(F.sum((~higher).cast("int")).alias(f"own_{r}"))
            sums.append(F.sum(F.when(seed, 1.0).when(higher, s).otherwise(0.0)).alias(f"gain_{r}"))
        gained = held.join(scores, "value").groupBy("before").agg(*sums)
        raised = {
            f"now_{r}": F.when(
                F.col(f"seeds_{r}") + F.col(f"new_{r}") >= min_support,
                F.greatest(
                    F.col(f"c_{r}"),
                    (F.col(f"seeds_{r}") + F.col(f"gain_{r}")) / (F.col("degree") + 1 - F.col(f"own_{r}")),
                ),
            ).otherwise(0.0)
            for r in kinds
        }
        rise = F.greatest(*[F.col(f"now_{r}") - F.col(f"c_{r}") for r in kinds])
        grown = sure.join(gained, "before").withColumns(raised).withColumn("rise", rise)
        kept = [c for c in sure.columns if not c.startswith("c_")]
        grown = materialize(grown.select(*kept, *[F.col(f"now_{r}").alias(f"c_{r}") for r in kinds], "rise"), "confidence")
        sure = grown.drop("rise")
        if grown.where(F.col("rise") > CHANGE).isEmpty():
            break
    told = sure.where(best >= min_score).select("before")
    return bounded_join(links, told, ["before"], [F.col("value")], F.octet_length("before")).select("before", "value")


def discover(
    found: DataFrame, max_rounds: int = MAX_ROUNDS, min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT
) -> DataFrame:
    """Spans of kind identifier per (doc_id, text_hash): array ``added``, for rows that have any.

    ``found`` has doc_id, text_hash and matches.
    """
    seen = found.select("doc_id", "text_hash", F.explode("matches").alias("m")).select(
        "doc_id", "text_hash", "m.start", "m.end", "m.rank", "m.before", "m.value"
    )
    edges = materialize(seen.select("before", "value", "rank").distinct(), "edges")
    accepted = score_graph(edges, max_rounds, min_score, min_support)
    loose = len(PATTERNS)
    hits = seen.where(F.col("rank") == loose).join(accepted, ["before", "value"], "left_semi")
    each = hits.select("doc_id", "text_hash", "start", "rank", "end").distinct()
    return each.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added")
    )


def _slim(matches: Column) -> Column:
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"))
    )


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, base and spans, arrays of (start, rank, end)."""
    found = scan(texts(docs), "text", "matches").select("doc_id", F.xxhash64("text").alias("text_hash"), "matches")
    found = materialize(found, "pii_matches")
    added = discover(found).select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    base = _slim(base_spans(F.col("matches")))
    return found.join(added, same, "left").select(
        "doc_id",
        "text_hash",
        base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce("added", F.array()))).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans and all spans as text."""
    spans = find(docs)
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return spans.select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(PATTERNS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by its kind in brackets."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["parts"], F.array(kept, F.get(kinds, s["rank"])))).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(
        spans,
        zero,
        step,
        lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substr(text, acc["at"] + 1, F.length(text)))), ""),
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` masked and ``n_chars`` counted anew where it changed."""
    spans = find(docs).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct()
    d, h, s = (unused(docs, c) for c in ("span_doc", "span_hash", "span_list"))
    spans = spans.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("spans").alias(s))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(h)
    )
    has = F.col(s).isNotNull()
    joined = docs.join(spans, same, "left")
    new = joined.withColumn("text", F.when(has, masked(F.col("text"), F.col(s))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(has, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return new.drop(d, h, s)
