"""Line dedup by winnowing, in DataFrame functions only.

A text is a sequence of lines, of which the blank ones count for nothing: a passage is the same however it is spaced.
The gram of a line is that line and those after it up to GRAM words; of the grams that begin within any WINDOW words, the
one of least hash is a fingerprint. So every run of lines of GRAM + WINDOW - 1 words or more has a fingerprint that depends
on nothing outside it. A fingerprint is joined with its first occurrence in the order of doc_id and line, and the match is
extended line by line both ways over the lines that travel with it. Where it ends there, it is extended further along the
first occurrence of the fingerprint together with its next line, next two lines and so on, so that of all earlier
occurrences the one that agrees longest counts, either way. What agrees is deleted, with the blank lines in it and those
about it that the earlier occurrence has too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

GRAM, WINDOW = 25, 25


def _hash(text: F.Column) -> F.Column:
    """60 bits of md5, which other engines have too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line, h, n_words, n_lines) of the lines that hold words: white space at the ends cut, runs of it made one blank."""
    each = docs.select("doc_id", "mark", F.split("text", "\n").alias("all")).select("doc_id", "mark", F.size("all").alias("n_lines"), F.posexplode("all").alias("line", "raw"))
    plain = F.trim(F.regexp_replace("raw", r"[\x20\x09-\x0D]+", " "))
    n = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    return each.select("doc_id", "mark", "line", "n_lines", plain.alias("plain")).where("plain <> ''").select("doc_id", "mark", "line", _hash(F.col("plain").cast("binary")).alias("h"), n.cast("long").alias("n_words"), "n_lines")


def fingerprints(lined: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(gram, doc_id, mark, line, near_before, near_after, above, below): the winnowed grams and the lines about them, nearest first.

    Here `line` counts lines with words only. `above` has the blank lines above the gram's line and above each of
    near_before, `below` those below its line and below each of near_after; both are null where there are none.
    """
    by_line = Window.partitionBy("doc_id", "mark").orderBy("line")
    at = Window.partitionBy("doc_id", "mark").orderBy("start")
    reach = gram + window - 2
    once = lined.withColumn("last", F.lag("line", 1, -1).over(by_line)).where("line > last")  # equal rows have each line again
    rows = once.select(
        "doc_id", "mark", (F.row_number().over(by_line) - 1).alias("line"), "h", "n_words", (F.sum("n_words").over(by_line) - F.col("n_words")).alias("start"),
        (F.col("line") - F.col("last") - 1).alias("up"), (F.coalesce(F.lead("line").over(by_line), F.col("n_lines")) - F.col("line") - 1).alias("down"),
    )
    rows = rows.select(
        "doc_id", "mark", "line", "start", "down",
        F.collect_list("h").over(at.rangeBetween(0, gram - 1)).alias("own"),
        F.sum("n_words").over(at.rangeBetween(0, gram - 1)).alias("own_words"),
        F.collect_list("h").over(at.rangeBetween(-window, -1)).alias("before"),
        F.collect_list("h").over(at.rangeBetween(0, reach)).alias("ahead"),
        F.collect_list("up").over(at.rangeBetween(-window, 0)).alias("ups"),
        F.collect_list("down").over(at.rangeBetween(0, reach)).alias("downs"),
    )
    rows = rows.withColumn("near_after", F.coalesce(F.lead("ahead").over(by_line), F.array().cast("array<bigint>"))).drop("ahead")
    rows = rows.withColumn("downs", F.concat(F.array("down"), F.coalesce(F.lead("downs").over(by_line), F.array().cast("array<int>")))).drop("down")
    whole = F.when(F.col("own_words") >= gram, F.struct(_hash(F.array_join(F.transform("own", lambda x: x.cast("string")), ",").cast("binary")).alias("gram"), "line"))
    rows = rows.withColumn("cand", whole).drop("own", "own_words")
    # A gram is chosen if it is the least of some window: of the windows that begin up to `window` words before it.
    rows = rows.withColumn("least", F.min("cand").over(at.rangeBetween(0, window - 1)))
    chosen = F.array_contains(F.collect_list(F.col("least.line")).over(at.rangeBetween(-(window - 1), 0)), F.col("line"))
    rows = rows.withColumn("chosen", chosen).where("cand is not null and chosen")
    above, below = (F.when(F.array_max(c) > 0, F.reverse(c) if c == "ups" else F.col(c)) for c in ("ups", "downs"))
    return rows.select(F.col("cand.gram").alias("gram"), "doc_id", "mark", "line", F.reverse("before").alias("near_before"), "near_after", above.alias("above"), below.alias("below"))


def _agreeing(a: str, b: str) -> F.Column:
    """How many entries two arrays have in common from the start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _gap(blank: str, n: F.Column) -> F.Column:
    """The blank lines beyond the n-th line."""
    return F.coalesce(F.get(blank, n), F.lit(0))


def _further(side: str, near: str, n: str, blank: str) -> F.Column:
    """(side, depth, key, gap) for each number of lines over `n` that `near` has; the key stands for the lines so far."""
    depths = F.when(F.size(near) > F.col(n), F.sequence(F.col(n) + 1, F.size(near))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda d: F.struct(F.lit(side).alias("side"), d.alias("depth"), F.xxhash64(F.slice(near, F.lit(1), d)).alias("key"), _gap(blank, d).alias("gap")))


def repeats(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, from, to, up, down): runs of lines that occur earlier, and the blank lines above and below that go with them.

    Takes doc_id, mark (a hash of the text) and text; equal rows are one. Lines are counted from 0 and without the blank
    ones. Runs may overlap.
    """
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "mark", "text")
    found = common.stored(fingerprints(lines(known), gram, window), "fingerprints")
    at = F.struct("doc_id", "mark", "line").alias("at")
    # Stored, so that Spark can split the rows of a passage that many documents share in the join.
    firsts = common.stored(found.groupBy("gram").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "mark", "line", "near_before", "near_after", "above", "below")).alias("first")).where("m > 1").select("gram", "m", "first"), "firsts")
    later = found.join(firsts, "gram").where("struct(doc_id, mark, line) > struct(first.doc_id, first.mark, first.line)")
    later = later.withColumn("first_before", F.col("first.near_before")).withColumn("first_after", F.col("first.near_after"))
    later = later.withColumn("n_before", _agreeing("near_before", "first_before")).withColumn("n_after", _agreeing("near_after", "first_after"))
    up, down = (F.least(_gap(c, F.col(n)), _gap(f"first.{c}", F.col(n))) for c, n in (("above", "n_before"), ("below", "n_after")))
    # An occurrence that agrees with this one further than the first does leaves the first at the same line, so both have a
    # row for every depth beyond; with two occurrences of a gram there is no other.
    beyond = F.when(F.col("m") > 2, F.concat(_further("above", "near_before", "n_before", "above"), _further("below", "near_after", "n_after", "below")))
    later = common.stored(later.select("gram", "doc_id", "mark", "line", "n_before", "n_after", up.alias("up"), down.alias("down"), beyond.alias("beyond")), "later")
    runs = later.select("doc_id", "mark", (F.col("line") - F.col("n_before")).alias("from"), (F.col("line") + F.col("n_after")).alias("to"), "up", "down")
    deep = later.select("gram", at, F.explode("beyond").alias("_b")).select("gram", "at", "_b.*")
    same = ["gram", "side", "depth", "key"]
    least = common.stored(deep.groupBy(*same).agg(F.count("*").alias("m"), F.min(F.struct("at", "gap")).alias("first")).where("m > 1").select(*same, "first"), "least")
    further = deep.join(least, same).where(F.col("at") > F.col("first.at")).groupBy("at", "side").agg(F.max(F.struct("depth", F.least("gap", "first.gap").alias("gap"))).alias("best"))
    depth, gap, above = F.col("best.depth"), F.col("best.gap"), F.col("side") == "above"
    more = further.select(
        "at.doc_id", "at.mark", (F.col("at.line") - F.when(above, depth).otherwise(0)).alias("from"), (F.col("at.line") + F.when(above, 0).otherwise(depth)).alias("to"),
        F.when(above, gap).otherwise(0).alias("up"), F.when(above, 0).otherwise(gap).alias("down"),
    )
    return runs.union(more)


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The documents with later repeated runs of lines deleted from text, and n_lines, n_deleted before the own columns' end.

    Every run of gram + window - 1 words or more that occurs earlier (by doc_id, then line) is deleted, whatever stands
    around it there, and with it the lines next to it that the same earlier text has. A shorter run goes only if it holds
    a fingerprint, and never one under `gram` words. A null text stays null with 0 lines; an empty text is one blank
    line; a null doc_id has no place in the order, so its text
    stays as it is. Equal rows are one document and are cut alike; other rows that share a doc_id are documents in
    the order of a hash of their texts. No row is ever dropped: of a whole repeated text an empty one remains. Blank lines count as no words and part no run; those inside a deleted run
    go with it, and of those next to it as many as the first occurrence has there.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").alias("_text"))
    runs = repeats(rows.select("doc_id", "mark", F.col("_text").alias("text")), gram, window).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("from", "to", "up", "down")).alias("_runs"))
    rows = rows.join(runs, ["doc_id", "mark"], "left").withColumn("_lines", F.split("_text", "\n"))
    spoken = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(common.WORD), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_spoken", F.when(F.col("_runs").isNotNull(), spoken))
    gone = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(F.get("_spoken", r["from"]) - r["up"], F.get("_spoken", r["to"]) + r["down"]))))
    rows = rows.withColumn("_gone", gone)
    kept = F.filter("_lines", lambda x, i: ~F.array_contains(F.col("_gone"), i))
    rows = rows.withColumn("_cut", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))
    text = [F.col("_cut").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in own]
    return rows.select(*text, F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_deleted"))


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted and the text that is left."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents' own columns, with the text that is left."""
    return dedup_lines(docs).drop("_n_lines", "_n_deleted")


ORACLE_SQL = f"""
WITH each AS (SELECT doc_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos, len(string_split(text, chr(10))) n_lines FROM documents WHERE text IS NOT NULL),
plain AS (SELECT *, trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') p FROM each),
lined AS (SELECT doc_id, pos, ('0x' || substr(md5(p), 1, 15))::BIGINT h, len(string_split(p, ' ')) n, row_number() OVER d - 1 line, pos - lag(pos, 1, -1) OVER d - 1 up, lead(pos, 1, n_lines) OVER d - pos - 1 down
  FROM plain WHERE p <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
placed AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY line) - n)::BIGINT s FROM lined),
grams AS (SELECT doc_id, line, s, down, list(h) OVER g own, sum(n) OVER g own_words, list(h) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) bef,
    list(up) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW) ups, list(h) OVER a ahead, list(down) OVER a downs
  FROM placed WINDOW g AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING), a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {GRAM + WINDOW - 2} FOLLOWING)),
cands AS (SELECT doc_id, line, s, list_reverse(coalesce(bef, [])) bef, list_reverse(ups) ups, coalesce(lead(ahead) OVER d, []) aft, [down] || coalesce(lead(downs) OVER d, []) downs,
    CASE WHEN own_words >= {GRAM} THEN {{'gram': ('0x' || substr(md5(array_to_string(own, ',')), 1, 15))::BIGINT, 'line': line}} END c FROM grams WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
chosen AS (SELECT DISTINCT doc_id, (min(c) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)).line line FROM cands),
prints AS (SELECT c.gram gram, doc_id, line, bef, aft, ups, downs FROM cands JOIN chosen USING (doc_id, line) WHERE c IS NOT NULL),
sides AS (SELECT gram, doc_id, line, 'a' side, bef near, ups gaps FROM prints UNION ALL SELECT gram, doc_id, line, 'b', aft, downs FROM prints),
depths AS (SELECT gram, doc_id, line, side, d, near[1:d] k, coalesce(gaps[d + 1], 0) gap FROM (SELECT *, unnest(range(0, len(near) + 1)) d FROM sides)),
firsts AS (SELECT doc_id, line, side, d, gap, first_value(doc_id) OVER f d0, first_value(line) OVER f l0, first_value(gap) OVER f g0 FROM depths WINDOW f AS (PARTITION BY gram, side, d, k ORDER BY doc_id, line)),
best AS (SELECT doc_id, line, side, max(d) d, arg_max(least(gap, g0), d) gap FROM firsts WHERE (doc_id, line) <> (d0, l0) GROUP BY ALL),
runs AS (SELECT doc_id, CASE side WHEN 'a' THEN line - d ELSE line END a, CASE side WHEN 'a' THEN line ELSE line + d END z, CASE side WHEN 'a' THEN gap ELSE 0 END up, CASE side WHEN 'a' THEN 0 ELSE gap END down FROM best),
gone AS (SELECT DISTINCT r.doc_id, unnest(range(f.pos - r.up, t.pos + r.down + 1)) pos FROM runs r JOIN lined f ON f.doc_id = r.doc_id AND f.line = r.a JOIN lined t ON t.doc_id = r.doc_id AND t.line = r.z),
left_over AS (SELECT l.doc_id, count(*) n_lines, count(g.pos) n_deleted, coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') t FROM each l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_deleted, 0) n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE t END AS text FROM documents d LEFT JOIN left_over USING (doc_id)
"""
