"""Benchmark decontamination by template canonicalisation, in DataFrame expressions alone.

Numbers, names (capitalised words inside a sentence) and units become typed placeholders that keep their value
(#n=5, #a=tom, #u=km). Windows of WINDOW tokens, values taken out, are hashed and joined with the benchmark's
windows. Hits of one document and item are grouped by the distance of their places; in a group the slots must be
consistent: a value of the item always stands for the same value in the document. So a question with other
numbers or names is found as well, and a chance likeness with mixed-up slots is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.llm.common import table

WINDOW = 8
#: Windows at one distance that make a hit (13 tokens in a row), or all of a shorter item.
NEEDED = 6
#: Share of a benchmark window's tokens that must be literal, in tenths, to be looked for whatever its slots hold.
LITERAL_TENTHS = 6
#: A benchmark of at most so many windows is broadcast (about 200 MB); a larger one is joined by shuffling.
BROADCAST_WINDOWS = 1_000_000
# Units, longer ones first.
UNITS = "kilometers|kilometres|kilograms|centimeters|millimeters|minutes|seconds|dollars|percent|meters|metres|hours|miles|grams|euros|liters|litres|years|days|km|kg|cm|mm|mg|ml|m|g|l|h|s"
STEPS = [
    (r"([0-9])[.,]([0-9])", r"$1_$2"),
    (r"([0-9])[.,]([0-9])", r"$1_$2"),
    (r"(^|[^\p{L}\p{N}_])([0-9]+(?:_[0-9]+)*)", r"$1 #n=$2 "),
    (rf"(#n=[0-9_]+) +({UNITS})([^\p{{L}}\p{{N}}]|$)", r"$1 #u=$2 $3"),
    (r"([\p{Ll},;:] )(\p{Lu}\p{Ll}+)", r"$1#a=$2"),
    (r"([\p{Ll},;:] )(\p{Lu}\p{Ll}+)", r"$1#a=$2"),
]
LAST = (r"[^\p{L}\p{N}#=_]+", " ")
VALUE = (r"=[^ ]*", "")


def canonical(text: str | Column) -> Column:
    """Lower-case tokens, one blank apart, with placeholders for numbers, units and names."""
    out = F.translate(F.col(text) if isinstance(text, str) else text, "#=_", "   ")
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(F.lower(out), *LAST))


def _templates(df: DataFrame, *carry: str, exact: bool = False) -> DataFrame:
    """carry, n (tokens), th (hash of each token, placeholders without value) and slots (place and token of the placeholders), from a column `canon`.

    With `exact` also slotted, tokens and eh (hash of each token as it is).
    """
    tokens = df.select(*carry, F.contains("canon", F.lit("#")).alias("slotted"), F.split("canon", " ").alias("tokens"))
    bare = lambda t: F.when(t.startswith("#"), F.substring_index(t, "=", 1)).otherwise(t)
    placed = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda s: s["token"].startswith("#"))
    more = ["slotted", "tokens", F.when(F.col("slotted"), F.transform("tokens", lambda t: F.xxhash64(t))).alias("eh")] if exact else []
    return tokens.select(*carry, F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(bare(t))).alias("th"), F.when(F.col("slotted"), placed).alias("slots"), *more)


def _literal(slots: Column, size: int | Column) -> Column:
    """Whether a window with so many placeholders has enough literal tokens to be looked for by its template."""
    return 10 * (size - slots) >= LITERAL_TENTHS * size


def _windows(templates: DataFrame, size: int, *carry: str, exact: bool = False) -> DataFrame:
    """carry, slots, pos (from 0) and h for all windows of that many tokens; with `exact`, h of a window with too many placeholders takes their values in."""
    own = lambda i: F.xxhash64(F.slice("th", i, size))
    if exact:
        held = lambda i: F.size(F.filter(F.slice("tokens", i, size), lambda t: t.startswith("#")))
        own = lambda i: F.when(F.col("slotted") & ~_literal(held(i), F.lit(size)), F.xxhash64(F.slice("eh", i, size))).otherwise(F.xxhash64(F.slice("th", i, size)))
    each = F.when(F.col("n") >= size, F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), own))
    return templates.select(*carry, "slots", F.posexplode(each).alias("pos", "h"))


def _within(slots: str, start: str, size: str) -> Column:
    """The placeholders of a window, in order."""
    inside = F.filter(slots, lambda s: (s["at"] >= F.col(start)) & (s["at"] < F.col(start) + F.col(size)))
    return F.coalesce(F.transform(inside, lambda s: s["token"]), F.array().cast("array<string>"))


def _after(word: str, text: str) -> Column:
    """The canonical form of a text as it reads after a word."""
    return F.regexp_replace(canonical(F.concat(F.lit(f"{word} "), F.regexp_replace(text, r"^\s+", ""))), "^[^ ]* ?", "")


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, item_windows, literal_windows, size, ipos, islots, literal, plain, h: windows of WINDOW tokens, or the whole of a shorter item.

    Windows that are not `literal` (too many placeholders) have the values in h, so only equal ones are found. What
    stands before an item in a document can make a name or unit of its first word: its first window is there in each
    such form, `plain` in the form of the item alone, and counts as literal if it is in all forms.
    """
    texts = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    forms = F.array(*[F.struct(c.alias("canon"), F.lit(p).alias("plain")) for c, p in ((canonical(text), True), (_after("a", text), False), (_after("1", text), False))])
    own = F.filter(forms, lambda f: f["plain"] | (f["canon"] != forms[0]["canon"]))
    items = texts.select(F.col(key).alias("item_id"), F.explode(own).alias("form"), forms[0]["canon"].alias("own")).select("item_id", "form.*", "own").where("canon != ''").distinct()
    sized = _templates(items, "item_id", "plain", "own", exact=True).withColumn("size", F.least("n", F.lit(WINDOW))).withColumn("item_windows", F.col("n") - F.col("size") + 1)
    held = lambda i: F.size(F.filter(F.slice("tokens", i, F.col("size")), lambda t: t.startswith("#")))
    sized = sized.withColumn("literal_windows", F.size(F.filter(F.sequence(F.lit(1), F.col("item_windows")), lambda i: _literal(held(i), F.col("size")))))
    of_item = Window.partitionBy("item_id", "own")
    sized = sized.withColumns({"literal_windows": F.min("literal_windows").over(of_item), "first_literal": F.min(_literal(held(F.lit(1)), F.col("size"))).over(of_item)})
    parts = [_windows(sized.where(F.col("size") == s), s, "item_id", "item_windows", "literal_windows", "size", "first_literal", "plain", exact=True).where("plain or pos = 0") for s in range(1, WINDOW + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("islots", _within("slots", "pos", "size")).withColumn("literal", _literal(F.size("islots"), F.col("size")) & (F.col("first_literal") | (F.col("pos") > 0)))
    return out.drop("slots", "first_literal").withColumnRenamed("pos", "ipos")


def _places(hits: Column) -> Column:
    return F.size(F.array_distinct(F.transform(hits, lambda h: h["ipos"])))


def _pairs(hits: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: h["pairs"])))


def _consistent(hits: Column) -> Column:
    return F.size(_pairs(hits)) == F.size(F.array_distinct(F.transform(_pairs(hits), lambda p: p["i"])))


def _changed(hits: Column) -> Column:
    return F.exists(_pairs(hits), lambda p: p["i"] != p["d"])


def _equal(hits: Column) -> Column:
    """Windows that the document has word for word."""
    return F.filter(hits, lambda h: ~F.exists(h["pairs"], lambda p: p["i"] != p["d"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it has: doc_id, item_id, windows (most at one distance),
    item_windows, reworded (in all such places some number, name or unit of the literal windows differs).

    NEEDED windows make a hit, or all of an item with fewer, or all its literal windows; windows with too many
    placeholders are found by their values. Slots must be consistent; windows that the document has word for word
    (NEEDED of them, 13 tokens in a row, or all of a shorter item) are a hit whatever others hold. Every item with a
    token is looked for: a short one that is a plain word hits every document with that word. Null and empty texts
    have none. Rows with equal keys count as one document.
    """
    wanted = benchmark_windows(benchmark)
    counts = {r["size"]: (r["n"], r["valued"]) for r in wanted.groupBy("size").agg(F.count("*").alias("n"), F.bool_or(~_literal(F.size("islots"), F.col("size"))).alias("valued")).collect()}
    if sum(n for n, _ in counts.values()) <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    valued = any(v for _, v in counts.values())
    templates = _templates(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), canonical(text).alias("canon")), "doc_id", exact=valued)
    hits = None
    for size in sorted({WINDOW, *counts}):
        own = _windows(templates, size, "doc_id", exact=counts.get(size, (0, False))[1]).join(wanted.where(F.col("size") == size), "h")
        hits = own if hits is None else hits.unionByName(own)
    pairs = F.arrays_zip(F.col("islots").alias("i"), _within("slots", "pos", "size").alias("d"))
    runs = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("distance")).agg(
        F.first("item_windows").alias("item_windows"),
        F.first("literal_windows").alias("literal_windows"),
        F.collect_set(F.struct("ipos", "literal", "plain", pairs.alias("pairs"))).alias("hits"),
    )
    literal = F.filter("hits", lambda h: h["literal"])
    plain = F.filter("hits", lambda h: h["literal"] & h["plain"])
    all_needed, literal_needed = (F.least(F.lit(NEEDED), F.col(c)) for c in ("item_windows", "literal_windows"))
    # By literal windows alone, or by all windows: then those with values must agree as well.
    by_literal = (F.col("literal_windows") > 0) & (_places(literal) >= literal_needed) & _consistent(literal)
    by_all = (_places(F.col("hits")) >= all_needed) & _consistent(F.col("hits"))
    # Hits of the plain form are counted and compared alone where they are enough.
    by_plain = (F.col("literal_windows") > 0) & (_places(plain) >= literal_needed) & _consistent(plain)
    verbatim = _places(_equal(F.col("hits")))
    by_part = verbatim >= all_needed
    windows = F.when(by_plain, _places(plain)).when(by_literal, _places(literal)).when(by_all, _places(F.col("hits"))).otherwise(verbatim)
    changed = F.when(by_plain, _changed(plain)).when(by_literal | by_all, _changed(literal)).otherwise(_changed(F.col("hits")))
    found = runs.where(by_plain | by_literal | by_all | by_part).select("doc_id", "item_id", "item_windows", windows.alias("windows"), changed.alias("changed"))
    return found.groupBy("doc_id", "item_id").agg(F.max("windows").cast("long").alias("windows"), F.first("item_windows").cast("long").alias("item_windows"), F.min("changed").alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose document has no benchmark item; rows without key stay."""
    gone = contaminated(docs, benchmark, key, text).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _duck_canonical(text: str) -> str:
    out = f"translate({text}, '#=_', '   ')"
    for pattern, by in STEPS:
        for g in "123":
            by = by.replace(f"${g}", f"\\{g}")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace(lower({out}), '{LAST[0]}', ' ', 'g'))"


def _duck_after(word: str) -> str:
    return f"regexp_replace({_duck_canonical(f"concat('{word} ', regexp_replace(text, '^\\s+', ''))")}, '^[^ ]* ?', '')"


_SLOTS = "list_filter({0}, lambda t: starts_with(t, '#'))"
_ENOUGH = f"10 * (size - len({_SLOTS})) >= {LITERAL_TENTHS} * size"
_WORDS = f"CASE WHEN literal THEN regexp_replace(array_to_string(w, ' '), '{VALUE[0]}', '', 'g') ELSE array_to_string(w, ' ') END AS h"
_KINDS = ("every", "lit", "plains", "verbatim")
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split({_duck_canonical("text")}, ' ') AS tokens FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_duck_canonical("text")} AS own, {_duck_after("a")} AS worded, {_duck_after("1")} AS counted FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
f AS (SELECT DISTINCT item_id, own, own AS canon, true AS plain FROM b UNION SELECT item_id, own, worded, false FROM b WHERE worded <> own UNION SELECT item_id, own, counted, false FROM b WHERE counted <> own),
bs AS (SELECT *, string_split(canon, ' ') AS tokens, least(len(string_split(canon, ' ')), {WINDOW}) AS size FROM f WHERE canon <> ''),
bp AS (SELECT *, unnest(range(len(tokens) - size + 1)) AS ipos FROM bs),
bw AS (SELECT *, list_slice(tokens, ipos + 1, ipos + size) AS w, {_ENOUGH.format("list_slice(tokens, ipos + 1, ipos + size)")} AS literal FROM bp),
bl AS (SELECT item_id, own, min(n) AS literal_windows, bool_and(first_literal) AS first_literal FROM (SELECT item_id, own, canon, plain, count(*) FILTER (literal) AS n, bool_or(literal) FILTER (ipos = 0) AS first_literal FROM bw GROUP BY ALL) GROUP BY ALL),
bx AS (SELECT item_id, plain, size, ipos, len(tokens) - size + 1 AS item_windows, literal_windows, literal AND (first_literal OR ipos > 0) AS literal, {_SLOTS.format("w")} AS si, {_WORDS}
       FROM bw JOIN bl USING (item_id, own) WHERE plain OR ipos = 0),
sizes AS (SELECT DISTINCT size FROM bs),
dp AS (SELECT doc_id, tokens, size, unnest(range(len(tokens) - size + 1)) AS pos FROM d, sizes WHERE len(tokens) >= size),
dw AS (SELECT doc_id, size, pos, list_slice(tokens, pos + 1, pos + size) AS w, {_ENOUGH.format("list_slice(tokens, pos + 1, pos + size)")} AS literal FROM dp),
dx AS (SELECT doc_id, size, pos, {_SLOTS.format("w")} AS sd, {_WORDS} FROM dw),
hits AS (SELECT doc_id, item_id, pos - ipos AS distance, item_windows, literal_windows, {{'ipos': ipos, 'literal': literal, 'plain': plain, 'pairs': list_transform(list_zip(si, sd), lambda p: {{'i': p[1], 'd': p[2]}}), 'equal': si = sd}} AS hit FROM dx JOIN bx USING (size, h)),
runs AS (SELECT doc_id, item_id, distance, max(item_windows) AS item_windows, max(literal_windows) AS literal_windows, list(hit) AS every,
         list(hit) FILTER (hit.literal) AS lit, list(hit) FILTER (hit.literal AND hit.plain) AS plains, list(hit) FILTER (hit.equal) AS verbatim FROM hits GROUP BY ALL),
places AS (SELECT * EXCLUDE ({", ".join(_KINDS)}), {", ".join(f"coalesce(list_unique(list_transform({k}, lambda x: x.ipos)), 0) AS n_{k}, coalesce(list_distinct(flatten(list_transform({k}, lambda x: x.pairs))), []) AS p_{k}" for k in _KINDS)} FROM runs),
judged AS (SELECT *, {", ".join(f"len(p_{k}) = list_unique(list_transform(p_{k}, lambda p: p.i)) AS c_{k}, len(list_filter(p_{k}, lambda p: p.i <> p.d)) > 0 AS x_{k}" for k in _KINDS)} FROM places),
ruled AS (SELECT *, literal_windows > 0 AND n_plains >= least({NEEDED}, literal_windows) AND c_plains AS by_plain, literal_windows > 0 AND n_lit >= least({NEEDED}, literal_windows) AND c_lit AS by_literal,
          n_every >= least({NEEDED}, item_windows) AND c_every AS by_all, n_verbatim >= least({NEEDED}, item_windows) AS by_part FROM judged),
told AS (SELECT doc_id, item_id, item_windows, CASE WHEN by_plain THEN n_plains WHEN by_literal THEN n_lit WHEN by_all THEN n_every ELSE n_verbatim END AS windows,
         CASE WHEN by_plain THEN x_plains WHEN by_literal OR by_all THEN x_lit ELSE x_every END AS changed FROM ruled WHERE by_plain OR by_literal OR by_all OR by_part)
SELECT doc_id, item_id, CAST(max(windows) AS BIGINT) AS windows, CAST(max(item_windows) AS BIGINT) AS item_windows, bool_and(changed) AS reworded FROM told GROUP BY doc_id, item_id
"""
