"""Queries of line splitting over whole texts, and the rules once more as SQL over any table `pairs` of originals and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linesplit, markup
from ..operators import quality
from ..session import spread
from . import adapters as A
from .queries import PAIRS, SYMBOL_KINDS, query

_TAGS = linesplit.NO_TEXT.replace("'", "''")
_WORDS = ", ".join(f"'{w}'" for w in linesplit.NO_START)
_BARE = rf"regexp_replace(x, '{_TAGS}', '', 'g')"
_CUT = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_FIRST = rf"""regexp_replace(regexp_extract({{0}}, '^\s*([^\s]+)', 1), '{linesplit.OPENING_MARKS.replace("'", "''")}', '')"""


def scores_sql(pairs: str, name: str) -> str:
    """CTEs that end in `name`(path, score, o, t, causes): the badness of each pair of the table `pairs`(path, original, translation)."""
    lines = lambda c: rf"list_filter(regexp_split_to_array({c}, '\r?\n'), lambda x: regexp_matches(x, '[^\s]'))"
    facts = lambda c: (
        f"list_transform({lines(c)}, lambda x: {{'words': len(regexp_extract_all({_BARE}, '[^\\s]+')), 'chars': length({_CUT.format(_BARE)}), "
        f"'bad': {_FIRST.format(_CUT.format('x'))} IN ({_WORDS}), 'clean': regexp_matches(right({_CUT.format(_BARE)}, 1), '{linesplit.SENTENCE_END}')}})"
    )
    ratios = lambda c: (
        f"(SELECT coalesce(list(CAST(upto - 1 AS DOUBLE) / total ORDER BY k) FILTER (k < n), []) FROM (SELECT k, n, total, sum(length(p) + 1) OVER (ORDER BY k) AS upto FROM ("
        f"SELECT unnest(string_split({c}, chr(10))) AS p, generate_subscripts(string_split({c}, chr(10)), 1) AS k, len(string_split({c}, chr(10))) AS n, length({c}) AS total)))"
    )
    short = "(z.words > 0 AND z.words <= 2 AND i <= len(o) AND o[i].words >= 4) OR (z.words = 1 AND len(t) > 2)"
    broken = "i > 1 AND NOT t[i - 1].clean AND (z.bad OR (t[i - 1].words >= 6 AND z.words <= 3))"
    count = lambda test: f"len(list_filter(list_transform(t, lambda z, i: coalesce({test}, false)), lambda x: x))"
    marks = ", ".join(f"CASE WHEN s{i} > 0 THEN '{c}' END" for i, c in enumerate(linesplit.CAUSES))
    return f"""
{name}_texts AS (SELECT path, original, translation, {_BARE.replace('(x,', '(original,')} AS po, {_BARE.replace('(x,', '(translation,')} AS pt FROM {pairs}),
{name}_facts AS (SELECT path, {facts('original')} AS o, {facts('translation')} AS t, {ratios('po')} AS ro, {ratios('pt')} AS rt FROM {name}_texts),
{name}_parts AS (
  SELECT path, len(o) AS o, len(t) AS t,
    CASE WHEN len(o) > 1 AND len(t) <> len(o) THEN least(50, 22 + 14 * abs(len(t) - len(o))) ELSE 0 END AS s0,
    CASE WHEN len(t) > 1 THEN least(30, 14 * {count(short)}) ELSE 0 END AS s1,
    CASE WHEN len(t) > 1 AND len(o) > 0 THEN least(25, 10 * {count("z.chars / mean < 0.35 OR z.chars / mean > 2.2")}) ELSE 0 END AS s2,
    CASE WHEN len(t) > 1 THEN least(35, 18 * {count(broken)}) ELSE 0 END AS s3,
    CASE WHEN len(o) > 1 AND len(t) = len(o) AND len(ro) = len(rt)
      THEN least(20, 10 * len(list_filter(range(1, len(ro) + 1), lambda i: abs(ro[i] - rt[i]) > 0.18))) ELSE 0 END AS s4
  FROM (SELECT *, coalesce(nullif(CAST(list_sum(list_transform(o, lambda x: x.chars)) AS DOUBLE) / greatest(len(o), 1), 0), 1) AS mean FROM {name}_facts)),
{name} AS (SELECT path, CAST(least(100, s0 + s1 + s2 + s3 + s4) AS INTEGER) AS score, CAST(o AS INTEGER) AS o, CAST(t AS INTEGER) AS t, list_filter([{marks}], lambda x: x IS NOT NULL) AS causes FROM {name}_parts)"""


def proposals_sql(pairs: str, name: str) -> str:
    """CTEs that end in `name`(path, proposed); the breaks take their blanks one after another, as a recursion over a text's breaks."""
    may = "b.pos >= 1 AND b.pos < size - 1 AND NOT b.bad"
    return rf"""
{name}_joined AS (
  SELECT path, translation, regexp_matches(translation, '[^\s]') AS filled,
    list_transform(list_filter(regexp_split_to_array(original, '\r?\n'), lambda x: regexp_matches(x, '[^\s]')), lambda x: length({_CUT.format(_BARE)})) AS lens,
    {_CUT.format(r"regexp_replace(regexp_replace(translation, '\s*\n\s*', ' ', 'g'), '\s{2,}', ' ', 'g')")} AS joined
  FROM {pairs}),
{name}_words AS (SELECT path, k, w, length(joined) AS size, lead(w) OVER (PARTITION BY path ORDER BY k) AS after, sum(length(w) + 1) OVER (PARTITION BY path ORDER BY k) - 1 AS pos FROM (
  SELECT path, joined, unnest(string_split(joined, ' ')) AS w, generate_subscripts(string_split(joined, ' '), 1) AS k FROM {name}_joined WHERE filled AND len(lens) > 1)),
{name}_blanks AS (SELECT path, list({{'pos': CAST(pos AS BIGINT), 'worth': worth}} ORDER BY pos) AS blanks FROM (
  SELECT path, pos, size, {_FIRST.format('after')} IN ({_WORDS}) AS bad,
    1 + CASE WHEN regexp_matches(right(w, 1), '{linesplit.SENTENCE_END}') THEN 10 WHEN right(w, 1) IN ('؛', ';') THEN 3 ELSE 0 END
      + CASE WHEN length(w) >= 4 THEN 2 ELSE 0 END + CASE WHEN left(after, 1) IN ('«', '"', '(') THEN 2 ELSE 0 END + CASE WHEN length(after) >= 4 THEN 1 ELSE 0 END AS worth
  FROM {name}_words WHERE after IS NOT NULL) b WHERE {may} GROUP BY path),
{name}_spots AS (SELECT path, j, reach, floor(CAST(upto AS DOUBLE) / total * size + 0.5) AS spot FROM (
  SELECT path, j, n, length(joined) AS size, greatest(20, floor(length(joined) * 0.25 + 0.5)) AS reach,
    sum(x) OVER (PARTITION BY path ORDER BY j) AS upto, greatest(sum(x) OVER (PARTITION BY path), 1) AS total
  FROM (SELECT path, joined, len(lens) AS n, unnest(lens) AS x, generate_subscripts(lens, 1) AS j FROM {name}_joined WHERE filled AND len(lens) > 1)) WHERE j < n),
{name}_picks AS (
  SELECT path, 0 AS j, blanks AS rest, CAST([] AS BIGINT[]) AS taken FROM {name}_blanks
  UNION ALL
  SELECT path, j, list_filter(rest, lambda b: b.pos IS DISTINCT FROM best), CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END FROM (
    SELECT p.path, s.j, p.rest, p.taken,
      list_min(list_transform(list_filter(p.rest, lambda b: abs(b.pos - s.spot) <= s.reach), lambda b: {{'cost': abs(b.pos - s.spot) - 4 * b.worth, 'pos': b.pos}})).pos AS best
    FROM {name}_picks p JOIN {name}_spots s ON s.path = p.path AND s.j = p.j + 1)),
{name}_chosen AS (SELECT path, unnest(taken) AS pos FROM (SELECT path, taken FROM {name}_picks QUALIFY row_number() OVER (PARTITION BY path ORDER BY j DESC) = 1)),
{name}_laid AS (SELECT w.path, count(c.pos) AS n, {_CUT.format("string_agg(w.w || CASE WHEN w.after IS NULL THEN '' WHEN c.pos IS NOT NULL THEN chr(10) ELSE ' ' END, '' ORDER BY w.k)")} AS laid
  FROM {name}_words w LEFT JOIN {name}_chosen c ON c.path = w.path AND c.pos = w.pos GROUP BY w.path),
{name} AS (SELECT j.path, CASE WHEN NOT filled THEN translation WHEN len(lens) <= 1 THEN joined WHEN l.n > 0 THEN l.laid ELSE translation END AS proposed
  FROM {name}_joined j LEFT JOIN {name}_laid l ON l.path = j.path)"""


_NAMED = f"""{PAIRS}, named AS (SELECT 'root.l' || doc_id AS path, original, translation FROM pairs)"""


@query(
    f"""WITH RECURSIVE {_NAMED}, {scores_sql('named', 'scored')}, {proposals_sql('named', 'better')}
SELECT path, score, o AS orig_line_count, t AS tr_line_count, array_to_string(causes, ',') AS causes, proposed FROM scored JOIN better USING (path)"""
)
def line_split_scan(spark, sf_dir):
    """Scores and proposals of all pairs of an original and its changed copy."""
    rows = spread(A.text_pairs(spark, sf_dir).select("path", "original", "translation"))
    scored = rows.withColumn("d", linesplit.diagnose(F.col("original"), F.col("translation"))).withColumn("proposed", linesplit.propose(F.col("original"), F.col("translation")))
    return scored.select("path", "d.score", "d.orig_line_count", "d.tr_line_count", F.array_join("d.causes", ",").alias("causes"), "proposed")


@query(
    f"""WITH RECURSIVE {_NAMED}, {scores_sql('named', 'scored')}, {proposals_sql('named', 'better')}
SELECT path, CASE WHEN score >= 50 THEN 'high' ELSE 'medium' END AS severity, array_to_string(causes, '; ') AS reason, md5(proposed) AS proposed
FROM scored JOIN better USING (path) JOIN named USING (path) WHERE score >= 25 AND proposed <> '' AND proposed <> translation"""
)
def line_split_proposals(spark, sf_dir):
    """Entries that are badly split, how badly, why, and the better split before tags are restored."""
    return quality.badly_split(spread(A.text_pairs(spark, sf_dir)), compat=False).select("path", "severity", "reason", F.md5("proposed").alias("proposed"))


@query(
    f"""WITH RECURSIVE {_NAMED}, {scores_sql('named', 'scored')}, {proposals_sql('named', 'better')}
SELECT path, 'line-split' AS kind, CASE WHEN score >= 50 THEN 'high' ELSE 'medium' END AS severity,
  md5(regexp_replace(replace(replace(replace(original, '[XENO:wait a=b ]', ''), '[System:Color name=x ]', ''), '[/System:Color]', ''), '\\s+', '', 'g')) AS words, 1 AS waits, 1 AS opened, 1 AS closed, 0 AS others
FROM scored JOIN better USING (path) JOIN named USING (path) WHERE score >= 25 AND proposed <> '' AND proposed <> translation"""
)
def line_split_issues(spark, sf_dir):
    """Issues of badly split entries; their suggestions have the original's tags, each as often, and the translation's words."""
    rows = quality.scan_line_split(spread(A.text_pairs(spark, sf_dir)), compat=False)
    tags = {"waits": "[XENO:wait a=b ]", "opened": "[System:Color name=x ]", "closed": "[/System:Color]"}
    rows = rows.withColumn("n", F.size(F.regexp_extract_all("suggestion", F.lit(markup.ANY_TAG), 0)))
    counts = {name: markup.count_of(F.col("suggestion"), F.lit(tag)) for name, tag in tags.items()}
    others = (F.col("n") - sum(counts.values(), F.lit(0))).alias("others")
    words = F.md5(F.regexp_replace(F.regexp_replace("suggestion", markup.ANY_TAG, ""), r"[ \t\r\n]+", "")).alias("words")
    return rows.select("path", "kind", "severity", words, *[c.alias(n) for n, c in counts.items()], others)


_TURNS = """turns AS (SELECT a.conv_id || ':' || a.turn AS path, a.text AS original, b.text AS translation FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turn_pairs(spark, sf_dir):
    """Each turn with the next one as its translation: texts that have little to do with one another."""
    rows = A.table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translation"))
    return rows.join(after, ["conv_id", "turn"]).select(F.col("conv_id").alias("file"), F.col("turn").alias("index"), F.col("text").alias("original"), "translation")


@query(f"""WITH RECURSIVE {_TURNS}, {scores_sql('turns', 'scored')}, {proposals_sql('turns', 'better')}
SELECT path, score, array_to_string(causes, ',') AS causes, proposed FROM scored JOIN better USING (path)""")
def split_scores(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir).withColumn("d", linesplit.diagnose(F.col("original"), F.col("translation")))
    path = F.concat_ws(":", "file", "index").alias("path")
    return rows.select(path, "d.score", F.array_join("d.causes", ",").alias("causes"), linesplit.propose(F.col("original"), F.col("translation")).alias("proposed"))


@query(f"""WITH RECURSIVE {_NAMED}, {scores_sql('named', 'scored')}, {proposals_sql('named', 'better')},
again AS (SELECT path, original, proposed AS translation FROM named JOIN better USING (path)), {scores_sql('again', 'after')}
SELECT 'f' || (CAST(substr(path, 7) AS BIGINT) % 10) || ':' || substr(path, 7) AS key, s.score, md5(proposed) AS proposed, CASE WHEN proposed <> translation AND a.score <= 22 THEN 'easy' ELSE 'hard' END AS difficulty
FROM scored s JOIN better USING (path) JOIN named USING (path) JOIN after a USING (path) WHERE s.score >= 25 AND (proposed <> translation OR s.score >= 50)""")
def split_files(spark, sf_dir):
    """Badly split entries of files, joined with their translations by file and index."""
    rows = A.text_pairs(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("seg_no") % 10).cast("string")))
    entries = rows.select("file", F.col("seg_no").alias("index"), F.lit(None).cast("string").alias("label"), "original")
    said = rows.select("file", F.col("seg_no").alias("index"), F.col("translation").alias("text"))
    return quality.scan_line_split_files(entries, said).select("key", "diagnosis.score", F.md5("proposed").alias("proposed"), "difficulty")


@query(f"""WITH RECURSIVE {_NAMED}, {SYMBOL_KINDS}, {scores_sql('named', 'scored')}, {proposals_sql('named', 'better')}
SELECT path, kind FROM symbols UNION ALL
SELECT path, 'line-split' FROM scored JOIN better USING (path) JOIN named USING (path) WHERE score >= 25 AND proposed <> '' AND proposed <> translation""")
def reviewed(spark, sf_dir):
    """All scans that need no reviewer, over entries of any length."""
    return quality.review(spread(A.text_pairs(spark, sf_dir)), compat=False).select("path", "kind")
