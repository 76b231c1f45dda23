"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, the rest is lower-cased words; so a benchmark item and a copy of it with other numbers,
names or units share their templates. A run of capitalised words inside a sentence is one name; such a run that opens a sentence is a name
where the same text has it as one elsewhere. The word that follows a number is a unit, whatever it is: what varies between a copy and its
item is a slot, what does not vary costs nothing. Windows of WINDOW tokens of every whole document are hash-joined with the items' windows
(an item shorter than that is one window of its own length). Along each alignment of a document with an item the filled slots are compared:
where every value of the item stands for one value of the document, the alignment is consistent (two values may become the same one); others
are dropped. A pair is reported where consistent alignments cover COVERAGE of the item's windows: kind ``exact`` if all slots are equal,
else ``reparameterised``.

Null and empty texts have no tokens and match nothing; an item without tokens is never matched. Rows that share a document id are judged
together, rows with a null id are never reported, equal item ids count as one item. Long texts are read whole, other columns are not read.
Empty tables give an empty result.

The items' windows are broadcast only while their count is at most BROADCAST_ROWS (a row is under 1 KB); beyond, the join shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table, without

WINDOW, COVERAGE, BROADCAST_ROWS = 8, 0.5, 50_000
CAPITALS, NUMBER = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*", r"\p{N}+(?:[.,]\p{N}+)*"
NAME, OPENER, UNIT = rf"([\p{{Ll}},;:] )({CAPITALS})", rf"""(^|[.!?]["')]* +|\n\s*)({CAPITALS})""", rf"({NUMBER} ?)(\p{{L}}+)"
#: Marks before a name, a run of capitals that opens a sentence, and a unit, while tokens are cut.
NAMED, OPENS, MEASURES = "\x01", "\x02", "\x03"
TOKEN = rf"[\x01\x02]{CAPITALS}|\x03?\p{{L}}+|{NUMBER}"
SLOTS = ("<num>", "<name>", "<unit>")


def _java(pattern: str) -> str:
    """The pattern as Spark takes it, with the same matches. Java goes a level deeper with each repeat of a group that may have to give some
    back, so a long run of names or numbers overflows the stack, which ends the executor; possessive groups do not, and nothing that follows
    here fits what they would give back. A number is tried from its first digit only, white space from its last line end, so time is linear."""
    first = r"(\p{N}(?<!\p{N}\p{N})(?<!\p{N}[.,]\p{N})\p{N}*+"
    return pattern.replace(")*", ")*+").replace(r"(\p{N}+", first).replace(r"\n\s*", r"\n[ \t\f\r]*+")


def tokens(text: Column) -> Column:
    """Tokens (t: canonical, w: as written) of a text."""
    whole = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x01-\x03]", " ")
    named, opens, measures = map(_java, (NAME, OPENER, UNIT))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, named, f"$1{NAMED}$2"), opens, f"$1{OPENS}$2"), measures, f"$1{MEASURES}$2")
    # names that open a sentence too; bound to a variable, as an expression within the tokens' lambda would be evaluated for each token
    both = F.array_intersect(F.regexp_extract_all(whole, F.lit(named), F.lit(2)), F.regexp_extract_all(whole, F.lit(opens), F.lit(2)))
    of = lambda t, w: F.struct(t.alias("t"), w.alias("w"))
    rest = lambda x: F.substr(x, F.lit(2))
    mark = lambda x, m: x.startswith(F.lit(m))
    one = lambda kind, w: F.array(of(F.lit(kind), w))

    def token(x: Column, names: Column) -> Column:
        name = mark(x, NAMED) | (mark(x, OPENS) & F.array_contains(names, rest(x)))
        words = F.transform(F.split(rest(x), " "), lambda w: of(F.lower(w), w))
        return F.when(name, one("<name>", rest(x))).when(mark(x, OPENS), words).when(mark(x, MEASURES), one("<unit>", rest(x))).when(x.rlike(r"^\p{N}"), one("<num>", x)).otherwise(F.array(of(F.lower(x), x)))

    cut = F.regexp_extract_all(marked, F.lit(_java(TOKEN)), F.lit(0))
    return F.transform(F.array(F.struct(cut.alias("cut"), both.alias("names"))), lambda z: F.flatten(F.transform(z["cut"], lambda x: token(x, z["names"]))))[0]


def window_starts(tokens: Column, size: Column) -> Column:
    return F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(F.array().cast("array<int>"))


def _hashed(tokens: Column, size: int) -> Column:
    return F.transform(window_starts(tokens, F.lit(size)), lambda i: F.xxhash64(F.slice(tokens, i, size)))


def _windows(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """A row for each window: keys, pos, win (canonical text), raw (tokens as written)."""
    parts = [rows.select(*keys, "tokens", "raw", F.explode(window_starts(F.col("tokens"), F.lit(k))).alias("pos"), F.lit(k).alias("k")) for k in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    cut = lambda c: F.slice(c, F.col("pos"), F.col("k"))
    return out.select(*keys, "pos", cut("tokens").alias("win"), cut("raw").alias("raw"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, kind, n_matched, n_windows): the pairs reported."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("x")).select("item", F.col("x.t").alias("tokens"), F.col("x.w").alias("raw")).where(F.size("tokens") > 0)
    items = items.groupBy("item").agg(F.min_by(F.struct("tokens", "raw"), "tokens").alias("x")).select("item", "x.tokens", "x.raw")
    sizes = sorted({r[0] for r in items.select(F.least(F.size("tokens"), F.lit(WINDOW))).distinct().collect()}) or [WINDOW]  # WINDOW values at most
    own = items.withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW)))
    parts = [_windows(own.where(F.col("size") == k), ["item"], [k]) for k in sizes]
    wins = parts[0]
    for p in parts[1:]:
        wins = wins.union(p)
    wins = saved(wins.select("item", F.col("pos").alias("ipos"), "win", F.col("raw").alias("iraw"), F.xxhash64("win").alias("h")), "item-windows")
    small = wins.count() <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if small else df

    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    hashes = [_hashed(F.col("tokens"), k) for k in sizes]
    probes = docs.select("doc", tokens(F.col("text"))["t"].alias("tokens")).select("doc", F.explode(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("h"))
    found = saved(probes.join(held(wins.select("h").distinct()), "h", "left_semi").select("doc").distinct(), "candidates")
    near = docs.join(found, "doc", "left_semi").select("doc", tokens(F.col("text")).alias("x")).select("doc", F.col("x.t").alias("tokens"), F.col("x.w").alias("raw"))
    met = _windows(near, ["doc"], sizes).join(held(wins.drop("h")), "win")

    slot = F.filter(F.arrays_zip(F.col("win").alias("t"), F.col("iraw").alias("i"), F.col("raw").alias("d")), lambda x: x["t"].isin(*SLOTS))
    met = met.select("doc", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"), F.transform(slot, lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i"), x["d"].alias("d"))).alias("slots"))
    lines = met.groupBy("doc", "item", "diagonal").agg(F.collect_set("ipos").alias("hit"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    n, one = F.size("slots"), F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["t"], x["i"]))))
    lines = lines.where(one == n).withColumn("same", F.forall("slots", lambda x: x["i"] == x["d"]))
    pairs = lines.select("doc", "item", "same", F.explode("hit").alias("ipos")).groupBy("doc", "item").agg(F.count_distinct("ipos").alias("n_matched"), F.min("same").alias("same"))
    total = items.select("item", (F.size("tokens") - F.least(F.size("tokens"), F.lit(WINDOW)) + 1).cast("long").alias("n_windows"))
    out = pairs.join(held(total), "item").where(F.col("n_matched") >= COVERAGE * F.col("n_windows"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.when(F.col("same"), "exact").otherwise("reparameterised").alias("kind"), "n_matched", "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is reported. All columns stay."""
    return without(docs, id_col, contaminated(docs, benchmark, id_col).select(id_col))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    whole = "regexp_replace(coalesce(text, ''), '[\\x01-\\x03]', ' ', 'g')"
    marked = f"regexp_replace(regexp_replace(regexp_replace(s, '{NAME}', '\\1' || chr(1) || '\\2', 'g'), '{OPENER.replace(chr(39), chr(39) * 2)}', '\\1' || chr(2) || '\\2', 'g'), '{UNIT}', '\\1' || chr(3) || '\\2', 'g')"
    token = """CASE WHEN x[1] = chr(1) OR x[1] = chr(2) AND list_contains(names, x[2:]) THEN [{'t': '<name>', 'w': x[2:]}]
        WHEN x[1] = chr(2) THEN list_transform(string_split(x[2:], ' '), lambda w: {'t': lower(w), 'w': w}) WHEN x[1] = chr(3) THEN [{'t': '<unit>', 'w': x[2:]}]
        WHEN regexp_matches(x, '^\\p{N}') THEN [{'t': '<num>', 'w': x}] ELSE [{'t': lower(x), 'w': x}] END"""
    cut = lambda of, key: f"SELECT {key}, list_transform(x, lambda y: y.t) AS tokens, list_transform(x, lambda y: y.w) AS raw FROM (SELECT {key}, flatten(list_transform(regexp_extract_all({marked}, '{TOKEN}'), lambda x: {token})) AS x FROM (SELECT {key}, s, list_intersect(regexp_extract_all(s, '{NAME}', 2), regexp_extract_all(s, '{OPENER.replace(chr(39), chr(39) * 2)}', 2)) AS names FROM (SELECT {key}, {whole} AS s FROM {of} WHERE {key} IS NOT NULL)))"
    return f"""
WITH items AS ({cut('benchmark', 'item_id')}),
own AS (SELECT *, least(len(tokens), {WINDOW}) AS k FROM items WHERE len(tokens) > 0),
d AS ({cut('documents', 'doc_id')}),
iw AS (SELECT item_id, p AS ipos, tokens[p:p + k - 1] AS win, raw[p:p + k - 1] AS iraw, len(tokens) - k + 1 AS n_windows FROM own, LATERAL (SELECT unnest(range(1, len(tokens) - k + 2)) AS p)),
dw AS (SELECT doc_id, p AS pos, tokens[p:p + k - 1] AS win, raw[p:p + k - 1] AS raw FROM d, (SELECT DISTINCT k FROM own), LATERAL (SELECT unnest(range(1, len(tokens) - k + 2)) AS p)),
met AS (SELECT doc_id, item_id, ipos, pos - ipos AS diagonal, n_windows, win, iraw, raw FROM dw JOIN iw USING (win)),
slots AS (SELECT DISTINCT doc_id, item_id, diagonal, t, i, w FROM (SELECT doc_id, item_id, diagonal, unnest(win) AS t, unnest(iraw) AS i, unnest(raw) AS w FROM met) WHERE t IN ('<num>', '<name>', '<unit>')),
judged AS (SELECT doc_id, item_id, diagonal, count(DISTINCT (t, i)) = count(*) AS fits, bool_and(i = w) AS same FROM slots GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, max(n_windows) AS n_windows, count(DISTINCT ipos) AS n_matched, bool_and(coalesce(same, true)) AS same FROM met LEFT JOIN judged USING (doc_id, item_id, diagonal) WHERE coalesce(fits, true) GROUP BY ALL)
SELECT doc_id, item_id, CASE WHEN same THEN 'exact' ELSE 'reparameterised' END AS kind, n_matched::BIGINT AS n_matched, n_windows::BIGINT AS n_windows FROM pairs WHERE n_matched >= {COVERAGE} * n_windows"""


ORACLE_SQL = _sql()
