"""Queries over documents, pages, conversations and labels: text, dedup, quality, evaluation and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import json as J
from quillon.functions import math as M
from quillon.functions import text as T
from quillon.operators import dedup, evaluation, quality, versions
from quillon.plans.model import questions, table
from quillon.plans.registry import query
from quillon.storage import cut

_WS = "regexp_replace({x}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\v]+', '', 'g')"
_LD = "regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _lib(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("stem"))


@query("strict_signature_dups", f"SELECT md5(sig) AS sig, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, concat({_WS.format(x='text')}, '||') AS sig FROM documents) GROUP BY sig HAVING count(*) > 1")
def strict_signature_dups(spark, sf):
    d = _lib(spark, sf).select("id", F.md5(T.strict_signature(F.col("stem"))).alias("sig"))
    return d.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("loose_signature_dups", f"SELECT md5(sig) AS sig, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, {_LD.format(x='text')} AS sig FROM documents) GROUP BY sig HAVING count(*) > 1")
def loose_signature_dups(spark, sf):
    d = _lib(spark, sf).select("id", F.md5(T.loose_signature(F.col("stem"))).alias("sig"))
    return d.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("new_in_batch", f"""WITH s AS (SELECT doc_id, md5(concat({_WS.format(x='text')}, '||')) AS sig FROM documents) SELECT min(doc_id) AS doc_id FROM s WHERE doc_id % 2 = 1 AND sig NOT IN (SELECT sig FROM s WHERE doc_id % 2 = 0) GROUP BY sig""")
def new_in_batch(spark, sf):
    sig = F.md5(T.strict_signature(F.col("text")))
    d = _docs(spark, sf)
    known = d.filter("doc_id % 2 = 0").select(sig.alias("signature"))
    return dedup.new_in_batch(d.filter("doc_id % 2 = 1"), known, sig, "doc_id").select("doc_id")


@query("primary_wins", f"""WITH s AS (SELECT doc_id, source, md5(concat({_WS.format(x='text')}, '||')) AS sig FROM documents) SELECT doc_id FROM s WHERE source <> 'src0' AND sig NOT IN (SELECT sig FROM s WHERE source = 'src0')""")
def primary_wins(spark, sf):
    d = _docs(spark, sf).withColumn("signature", F.md5(T.strict_signature(F.col("text"))))
    return d.filter("source <> 'src0'").join(d.filter("source = 'src0'").select("signature"), "signature", "left_anti").select("doc_id")


@query("cross_library", f"""WITH p AS (SELECT item_id, concat({_WS.format(x='text')}, '||') AS s, {_LD.format(x='text')} AS l FROM benchmark), d AS (SELECT doc_id, concat({_WS.format(x='text')}, '||') AS s, {_LD.format(x='text')} AS l FROM documents),
    m AS (SELECT doc_id, CASE WHEN d.s = p.s AND d.s <> '||' THEN 1 WHEN d.l = p.l AND d.l <> '' THEN 2 WHEN length(p.l) >= 20 AND contains(d.l, p.l) THEN 3 END AS t, item_id FROM d, p)
    SELECT doc_id AS id, CASE min(t) WHEN 1 THEN 'strict' WHEN 2 THEN 'loose' ELSE 'contains' END AS tier, arg_min(item_id, (t, item_id)) AS primary_id FROM m WHERE t IS NOT NULL GROUP BY 1""")
def cross_library(spark, sf):
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("stem"))
    return dedup.cross_library(_lib(spark, sf), p)


@query("merge_memberships", "SELECT l_partkey AS signature, min(l_orderkey) AS ordinal, count(DISTINCT l_suppkey) AS papers FROM lineitem GROUP BY 1")
def merge_memberships(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select("l_partkey", F.col("l_orderkey").alias("ordinal"), F.array(F.struct(F.col("l_suppkey").alias("paper"), F.col("l_linenumber").alias("place"))).alias("papers"))
    return dedup.merged_in_batch(rows, F.col("l_partkey")).select("signature", "ordinal", F.size("papers").cast("long").alias("papers"))


@query("backfill_memberships", "SELECT p_partkey AS id, CAST(count(DISTINCT (l_orderkey, l_linenumber)) FILTER (WHERE l_linenumber > 1) AS INT) AS added FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def backfill_memberships(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("place"))
    have = li.filter("place = 1").groupBy("id").agg(F.collect_set(F.struct("paper", "place")).alias("papers"))
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(have, "id", "left")
    base = base.withColumn("papers", F.coalesce("papers", F.array().cast("array<struct<paper:bigint,place:int>>")))
    return dedup.backfilled(base, li).select("id", "added")


_GRAMS = f"""t AS (SELECT doc_id AS id, {_LD.format(x='text')} AS t FROM documents), g AS (SELECT DISTINCT id, substring(t, CAST(i AS INT), 3) AS gram FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM t WHERE length(t) >= 6)), grams AS (SELECT * FROM g WHERE id IN (SELECT id FROM g GROUP BY id HAVING count(*) >= 4))"""


def _texts(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")


@query("shingle_counts", f"WITH {_GRAMS} SELECT id, count(*) AS grams FROM grams GROUP BY 1")
def shingle_counts(spark, sf):
    return dedup.gram_sets(_texts(spark, sf)).groupBy("id").agg(F.count("*").alias("grams"))


_BITS = ", ".join(f"sum(CAST(substring(bits, {64 - b}, 1) AS INT)) AS b{b}" for b in range(64))
_FP = f"""{_GRAMS}, h AS (SELECT gram, concat(lpad(bin(CAST(concat('0x', substring(md5(gram), 1, 8)) AS BIGINT)), 32, '0'), lpad(bin(CAST(concat('0x', substring(md5(gram), 9, 8)) AS BIGINT)), 32, '0')) AS bits FROM (SELECT DISTINCT gram FROM grams)),
    v AS (SELECT id, count(*) AS n, {_BITS} FROM grams JOIN h USING (gram) GROUP BY id), fps AS (SELECT id, concat({", ".join(f"CASE WHEN 2 * b{b} > n THEN '1' ELSE '0' END" for b in reversed(range(64)))}) AS fp FROM v)"""


@query("simhash_fingerprints", f"WITH {_FP} SELECT id, fp FROM fps")
def simhash_fingerprints(spark, sf):
    return dedup.gram_prints(_texts(spark, sf)).select("id", "fp")


_BANDS = f"{_FP}, bands AS (SELECT id, b AS band, substring(fp, CAST(64 - 16 * (b + 1) + 1 AS INT), 16) AS key FROM fps, range(4) r(b)), ok AS (SELECT band, key FROM bands GROUP BY 1, 2 HAVING count(*) >= 2), cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id < y.id JOIN ok ON ok.band = x.band AND ok.key = x.key)"


@query("lsh_candidates", f"WITH {_BANDS} SELECT a, b FROM cand")
def lsh_candidates(spark, sf):
    """All pairs of documents that share a band of their fingerprints, those of copies among them."""
    return dedup.banded_pairs(cut(simhash_fingerprints(spark, sf), "prints"))


@query("lsh_oversized", f"WITH {_BANDS} SELECT CAST(band AS INT) AS band, key, count(*) AS n FROM bands GROUP BY 1, 2 HAVING count(*) > 8")
def lsh_oversized(spark, sf):
    return dedup.oversized(dedup.banded(simhash_fingerprints(spark, sf)), 8)


_JAC = f"{_BANDS}, n AS (SELECT id, count(*) AS n FROM grams GROUP BY 1), c AS (SELECT a, b, count(*) AS c FROM cand JOIN grams ga ON ga.id = a JOIN grams gb ON gb.id = b AND gb.gram = ga.gram GROUP BY 1, 2), jac AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE similarity >= 0.72)"


@query("shingle_jaccard_pairs", f"WITH {_JAC} SELECT a, b, round(similarity, 9) AS similarity FROM jac")
def shingle_jaccard_pairs(spark, sf):
    """All near pairs of documents, those of copies among them."""
    return dedup.near_pairs(_texts(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("dup_clusters", f"""WITH RECURSIVE {_JAC}, e AS (SELECT a, b FROM jac UNION SELECT b, a FROM jac), r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1)
    SELECT cluster, size, round(m, 9) AS similarity FROM (SELECT cluster, count(*) AS size FROM l GROUP BY 1) JOIN (SELECT l.cluster, max(similarity) AS m FROM jac JOIN l ON l.id = a GROUP BY 1) USING (cluster)""")
def dup_clusters(spark, sf):
    return dedup.duplicate_clusters(_texts(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("numbered_titles", "SELECT doc_id AS ordinal, source AS title, CASE WHEN row_number() OVER w > 1 THEN concat(source, '（', CAST(row_number() OVER w AS VARCHAR), '）') ELSE source END AS shown FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def numbered_titles(spark, sf):
    return dedup.numbered_titles(_docs(spark, sf).select(F.col("doc_id").alias("ordinal"), F.col("source").alias("title")))


# Text.

_HTML = "html"
for _p, _to in T.HTML_STEPS:
    _flags = "gi" if _p.startswith("(?i)") else "g"
    _HTML = "regexp_replace({}, '{}', '{}', '{}')".format(_HTML, _p.replace("(?i)", "").replace("'", "''"), _to.replace("'", "''").replace("$1", "\\1"), _flags)
_SPACES = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\v]"


@query("html_to_text", f"SELECT page_id, md5(regexp_replace({_HTML}, '^{_SPACES}+|{_SPACES}+$', '', 'g')) AS h FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("h"))


@query("html_assets", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<img[^>]*>')) AS INT) AS images, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS INT) AS links FROM pages")
def html_assets(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<img[^>]*>)"), 1)).alias("images"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("links"))


_LINES = "lines AS (SELECT doc_id AS doc, CAST(i AS INT) AS line_no, string_split(text, chr(10))[CAST(i + 1 AS INT)] AS line FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"
_STREAM = "(len([w for w in regexp_split_to_array(line, '\\s+') if w <> '']) >= 6 AND len([w for w in regexp_split_to_array(line, '\\s+') if regexp_matches(w, '^[-+]?[0-9,，]+(\\.[0-9]+)?[%％]?$')]) >= 0.6 * len([w for w in regexp_split_to_array(line, '\\s+') if w <> '']) AND NOT regexp_matches(line, '[一-鿿]'))"
_KIND = f"CASE WHEN {_STREAM} THEN 'stream' WHEN regexp_matches(line, '[0-9]\\.[0-9]+\\.[0-9]') THEN 'points' WHEN regexp_matches(line, '[０-９]') THEN 'wide' END"


def _lines(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("numeric_anomalies", f"WITH {_LINES}, f AS (SELECT doc, line_no, substring(line, 1, 60) AS s, {_KIND} AS kind FROM lines) SELECT doc, kind, count(*) AS lines, array_to_string(list(s ORDER BY line_no)[1:5], '|') AS samples FROM f WHERE kind IS NOT NULL GROUP BY 1, 2")
def numeric_anomalies(spark, sf):
    return quality.numeric_anomalies(_lines(spark, sf)).withColumn("samples", F.array_join("samples", "|"))


@query("table_quality", r"""WITH l AS (SELECT doc_id AS doc, text FROM documents), t AS (SELECT doc, CAST(len(regexp_extract_all(text, '(?is)<table.*?</table>')) AS BIGINT) AS h FROM l), p AS (SELECT doc, i, string_split(text, chr(10))[CAST(i AS INT)] AS line FROM (SELECT doc, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM l)),
    r AS (SELECT doc, i - row_number() OVER (PARTITION BY doc ORDER BY i) AS island, len(string_split(line, '|')) - 2 AS cells FROM p WHERE regexp_matches(line, '^\s*\|.*\|\s*$')), s AS (SELECT doc, island, min(cells) <> max(cells) AS ragged FROM r GROUP BY 1, 2),
    c AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE ragged) AS rg FROM s GROUP BY 1) SELECT t.doc, h + coalesce(n, 0) AS tables, coalesce(rg, 0) AS ragged, CASE WHEN h + coalesce(n, 0) > 0 THEN floor((1 - coalesce(rg, 0) / (h + coalesce(n, 0))) * 100 + 0.5) / 100 END AS confidence FROM t LEFT JOIN c ON c.doc = t.doc""")
def table_quality(spark, sf):
    return quality.table_quality(_docs(spark, sf).select(F.col("doc_id").alias("doc"), "text"))


@query("recurring_lines", "WITH p AS (SELECT lang AS doc, doc_id AS page, unnest(string_split(text, ' ')) AS text FROM documents), t AS (SELECT doc, count(DISTINCT page) AS total FROM p GROUP BY 1 HAVING total >= 4), c AS (SELECT doc, text, count(DISTINCT page) AS pages FROM p WHERE length(text) BETWEEN 1 AND 60 GROUP BY 1, 2) SELECT c.doc, text, pages FROM c JOIN t ON t.doc = c.doc WHERE pages / total >= 0.5")
def recurring_lines(spark, sf):
    """Words in the place of lines, a language's documents in the place of pages."""
    pages = _docs(spark, sf).select(F.col("lang").alias("doc"), F.col("doc_id").alias("page"), F.split("text", " ").alias("text"))
    return quality.recurring_lines(pages, length=60)


@query("repeated_headers", f"WITH {_LINES}, p AS (SELECT doc % 25 AS doc, doc AS page, line AS text, line_no FROM lines WHERE line_no < 2) SELECT doc, text, count(DISTINCT page) AS pages FROM p GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3")
def repeated_headers(spark, sf):
    pages = _lines(spark, sf).select((F.col("doc") % 25).alias("doc"), F.col("doc").alias("page"), F.col("line").alias("text"), (F.col("line_no") / 10).alias("top"))
    return quality.repeated_headers(pages, band=0.2)


@query("clean_line_counts", r"""WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r?\n')), E' \t\r\n') AS x FROM documents), c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '~+', '～', 'g'), '\s{2,}', ' ', 'g')) AS x FROM l) SELECT doc_id, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS chars FROM c WHERE x <> '' GROUP BY 1""")
def clean_line_counts(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.explode(T.clean_lines(F.col("text"))).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("x")).alias("chars"))


@query("search_snippet", r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#>*_`]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    q AS (SELECT doc_id, t, instr(lower(t), 'license') AS i FROM p) SELECT doc_id, concat(CASE WHEN i - 19 > 0 THEN '…' ELSE '' END, substring(t, greatest(i - 19, 0) + 1, 72), CASE WHEN greatest(i - 19, 0) + 72 < length(t) THEN '…' ELSE '' END) AS snippet FROM q WHERE i > 0""")
def search_snippet(spark, sf):
    return _docs(spark, sf).select("doc_id", T.snippet(F.col("text"), "License").alias("snippet")).filter("snippet is not null")


@query("safe_titles", r"""SELECT doc_id, substring(CASE WHEN t <> '' THEN t ELSE source END, 1, 80) AS title FROM (SELECT doc_id, source, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[\\/:*?"<>|]', ' ', 'g'), '[\s\x{A0}\x{3000}]+', ' ', 'g')) AS t FROM documents)""")
def safe_titles(spark, sf):
    return _docs(spark, sf).select("doc_id", T.safe_title(F.col("text"), F.col("source")).alias("title"))


@query("stable_ids", "SELECT doc_id, substring(sha256(concat(source, chr(10), lang)), 1, 24) AS sid FROM documents")
def stable_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", T.stable_id(F.col("source"), F.col("lang")).alias("sid"))


@query("digit_tokens", "SELECT doc_id, CAST(len(list_distinct([regexp_replace(x, '[^0-9.%]', '', 'g') for x in regexp_extract_all(text, '[0-9][0-9,.%：:]*')])) AS INT) AS n FROM documents")
def digit_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.digit_tokens(F.col("text"))).alias("n"))


@query("string_lists", "SELECT p_partkey, array_to_string([trim(x) for x in regexp_split_to_array(concat(p_name, ',', p_brand, '; ;', p_type), '[,，;；\n]') if trim(x) <> ''], '|') AS parts FROM part")
def string_lists(spark, sf):
    joined = F.concat(F.col("p_name"), F.lit(","), F.col("p_brand"), F.lit("; ;"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.string_list(joined), "|").alias("parts"))


@query("html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS h FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("h"))


@query("conversation_sanitize", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(role, turn) AS first_role FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY 1")
def conversation_sanitize(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    kept = turns.select("conv_id", J.messages(F.col("t")).alias("m")).filter(F.size("m") > 0)
    chars = F.aggregate("m", F.lit(0), lambda s, x: s + F.char_length(x["text"]))
    return kept.select("conv_id", F.size("m").cast("long").alias("turns"), chars.cast("long").alias("chars"), F.col("m")[0]["role"].alias("first_role"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", J.parsed(F.col("props"), "struct<k:int>", F.lit(None))["k"].alias("k"))


# Sampling and evaluation.


@query("stratified_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(concat('20260906:', CAST(doc_id AS VARCHAR))), doc_id) AS n FROM documents WHERE trim(text) <> '') WHERE n <= 3")
def stratified_sample(spark, sf):
    return evaluation.stratified(_docs(spark, sf).filter(F.trim("text") != ""), ["lang", "source"], 3, "20260906", "doc_id").select("doc_id")


_SPLIT = "CAST(concat('0x', substring(md5(concat('7:', source)), 1, 6)) AS BIGINT) / 16777216.0"


@query("leakage_free_split", f"""WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS n FROM documents), b AS (SELECT *, CASE WHEN {_SPLIT} < 0.6 THEN 'tune' WHEN {_SPLIT} < 0.8 THEN 'check' ELSE 'final' END AS set FROM a WHERE n <= 4),
    c AS (SELECT *, row_number() OVER (PARTITION BY set, lang ORDER BY md5(concat('7#:', CAST(doc_id AS VARCHAR))), doc_id) AS m FROM b) SELECT doc_id, source, set FROM c WHERE m <= 6""")
def leakage_free_split(spark, sf):
    return evaluation.leakage_free(_docs(spark, sf), "source", "lang", "doc_id", "7").select("doc_id", "source", "set")


@query("label_precision_recall", """SELECT lang, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
    round(CASE WHEN round(tp / nullif(tp + fp, 0), 6) + round(tp / nullif(tp + fn, 0), 6) > 0 THEN 2 * round(tp / nullif(tp + fp, 0), 6) * round(tp / nullif(tp + fn, 0), 6) / (round(tp / nullif(tp + fp, 0), 6) + round(tp / nullif(tp + fn, 0), 6)) WHEN tp + fp > 0 AND tp + fn > 0 THEN 0.0 END, 6) AS f1
    FROM (SELECT lang, quality = 1 AS t, length(text) > 300 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def label_precision_recall(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return evaluation.confusion(rows, F.col("quality") == 1, F.char_length("text") > 300, ["lang"])


@query("cer_pairs", "SELECT a.p_partkey, round(CASE WHEN length(a.p_name) = 0 THEN 1.0 ELSE least(1.0, levenshtein(a.p_name, b.p_name) / length(a.p_name)) END, 6) AS cer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def cer_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", F.round(M.character_error_rate(F.col("p_name"), F.col("other")), 6).alias("cer"))


def _close(x):
    return F.round(x, 4)


@query("metrics_grouping_sets", "SELECT source AS set, lang AS type, grouping_id(source, lang) AS level, count(*) AS pages, round(avg(CASE WHEN length(text) > 100 THEN length(text) END), 4) AS chars, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang))")
def metrics_grouping_sets(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("set"), F.col("lang").alias("type"), F.when(F.char_length("text") > 100, F.char_length("text")).alias("chars"), "toxic")
    return evaluation.aggregated(rows, ["chars"], ["toxic"]).withColumn("chars", _close(F.col("chars"))).withColumn("level", F.col("level").cast("long"))


@query("corpus_survey", "SELECT lang AS subject, source AS file, CAST(grouping_id(lang, source) AS BIGINT) AS level, count(DISTINCT source) AS files, count(*) AS pages, round_even(count(*) FILTER (WHERE length(text) < 200) / count(*), 4) AS scan_ratio, CAST(sum(doc_id % 3) AS BIGINT) AS images FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def corpus_survey(spark, sf):
    pages = _docs(spark, sf).select(F.col("lang").alias("subject"), F.col("source").alias("file"), F.col("doc_id").alias("page"), (F.char_length("text") >= 200).alias("has_text"), (F.col("doc_id") % 3).alias("images"))
    return evaluation.survey(pages).withColumn("level", F.col("level").cast("long"))


@query("length_by_type", "SELECT lang AS type, count(*) AS pages, CAST(round_even(avg(length(text)), 0) AS BIGINT) AS mean_chars FROM documents GROUP BY 1")
def length_by_type(spark, sf):
    return evaluation.lengths_by_type(_docs(spark, sf).select(F.col("lang").alias("type"), "text"))


@query("median_timing", "SELECT event_type AS engine, count(*) AS pages, median(value) AS median_ms, max(user_id) AS peak, count(*) FILTER (WHERE event_id % 11 = 0) AS errors FROM events GROUP BY 1")
def median_timing(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("ms"), F.col("user_id").alias("rss"), F.when(F.col("event_id") % 11 == 0, "e").alias("error"))
    return evaluation.timings(runs, small=1000)


_DIG = "list_distinct([regexp_replace(x, '[^0-9.%]', '', 'g') for x in regexp_extract_all({x}, '[0-9][0-9,.%：:]*')])"


_PLAIN = f"regexp_replace({_HTML}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


@query("digit_agreement", f"WITH p AS (SELECT {_DIG.format(x='html')} AS a, {_DIG.format(x=_PLAIN)} AS b FROM pages), q AS (SELECT a, b, len(list_intersect(a, b)) AS c FROM p WHERE len(a) > 0 OR len(b) > 0) SELECT count(*) AS pages, round(avg(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE c / (len(a) + len(b) - c) END), 6) AS agreement FROM q")
def digit_agreement(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("page"), "html")
    return evaluation.digit_agreement(p.select("page", F.col("html").alias("text")), p.select("page", T.html_to_text(F.col("html")).alias("text")))


@query("drop_suspects", r"""WITH n AS (SELECT l_orderkey AS doc, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem), d AS (SELECT doc, n, i, lag(n) OVER (PARTITION BY doc ORDER BY i) AS p FROM n), k AS (SELECT doc, n, lag(n) OVER (PARTITION BY doc ORDER BY i) AS q FROM d WHERE p IS NULL OR p <> n)
    SELECT doc, CAST(count(*) FILTER (WHERE q IS NOT NULL AND n - q <> 1) AS INT) AS suspects FROM k GROUP BY 1""")
def drop_suspects(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))), lambda s: s["l_linenumber"]).alias("n"))
    return li.select("doc", T.drop_suspects(F.col("n")).alias("suspects"))


# Versions.


@query("vault_diff", "SELECT coalesce(o.doc_id, n.doc_id) AS id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'updated' ELSE 'same' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE NOT contains(text, '###')) o FULL JOIN (SELECT doc_id, md5(trim(text, '.')) AS h FROM documents WHERE NOT contains(text, '%%%')) n ON o.doc_id = n.doc_id")
def vault_diff(spark, sf):
    """Documents as two cleanings leave them; each drops another kind of junk, the second also full stops at the ends."""
    d = _docs(spark, sf)
    old = d.filter(~F.col("text").contains("###")).select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"))
    new = d.filter(~F.col("text").contains("%%%")).select(F.col("doc_id").alias("id"), F.md5(F.trim("text", F.lit("."))).alias("content_hash"))
    return versions.diff(old, new)


@query("retention_topn", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def retention_topn(spark, sf):
    return versions.retained(table(spark, sf, "events"), "user_id", "ts", 5, "event_id").select("user_id", "event_id")


@query("latest_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_wins(spark, sf):
    return versions.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("favorite_toggles", "SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) % 2 = 1")
def favorite_toggles(spark, sf):
    return versions.toggled(table(spark, sf, "events").filter("event_type = 'click'"), "user_id", "ts")


@query("cache_eviction", "SELECT event_id AS key, CAST(round(value) AS BIGINT) AS bytes, ts AS used_at FROM (SELECT *, sum(round(value)) OVER (ORDER BY ts DESC, event_id) AS total FROM events) WHERE total > 20000")
def cache_eviction(spark, sf):
    """Events as a cache's entries."""
    entries = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.round("value").cast("long").alias("bytes"), F.col("ts").alias("used_at"))
    return versions.evicted(entries, 20_000, per_task=50_000)


@query("id_remap", "SELECT event_id, q.id * 10 + 1 AS question_id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) JOIN questions q ON q.id = k AND q.subject = 'a'")
def id_remap(spark, sf):
    """A subject's questions get new ids."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("question_id"))
    mapping = questions(spark, sf).filter("subject = 'a'").select(F.col("id").alias("old"), (F.col("id") * 10 + 1).alias("new"))
    return versions.remapped(e, mapping)


@query("publish_gate", "SELECT d.doc_id, (coalesce(lang, '') = 'en' AND NOT contains(text, '$$$')) OR coalesce(quality = 1, false) AS allowed FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def publish_gate(spark, sf):
    """Q-3: junk in a text stands for a pairing to be confirmed, a label of quality for a person's word."""
    able = F.when(F.col("lang") == "en", "text-supported").when(F.col("lang") == "fr", "table-review").otherwise("graphic-review")
    warned = F.when(F.col("text").contains("$$$"), F.array(F.lit("配对待确认：1"))).otherwise(F.array().cast("array<string>"))
    confirmed = table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("human_confirmed"))
    d = _docs(spark, sf).join(confirmed, "doc_id", "left").select("doc_id", able.alias("capability"), warned.alias("warnings"), "human_confirmed")
    return quality.gate(d).select("doc_id", "allowed")


_OF_ORDER = """SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, bool_or(l_linestatus = 'O') AS o,
    count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 25) AS whole, count(*) FILTER (WHERE l_quantity > 40) AS large, count(*) FILTER (WHERE l_quantity < 5) AS small, count(*) FILTER (WHERE l_tax > 0.06) AS taxed FROM lineitem GROUP BY 1"""


def _of_order(spark, sf):
    flag, amount = F.col("l_returnflag"), F.col("l_quantity")
    counts = {"a": flag == "A", "n": flag == "N", "r": flag == "R", "whole": (flag == "N") & (amount > 25), "large": amount > 40, "small": amount < 5, "taxed": F.col("l_tax") > 0.06}
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("o"), *(F.count_if(c).alias(k) for k, c in counts.items()))


@query("capability_counts", f"SELECT CASE WHEN a >= 4 THEN 'graphic-review' WHEN n = 0 AND o AND large >= 5 THEN 'image-only-review' WHEN n = 0 THEN 'unsupported-auto-structure' WHEN taxed > 1 OR 4 * r >= 10 THEN 'table-review' ELSE 'text-supported' END AS capability, count(*) AS n FROM ({_OF_ORDER}) GROUP BY 1")
def capability_counts(spark, sf):
    """Q-1: orders as files, counts of their lines as signals."""
    d = _of_order(spark, sf).select((F.col("a") >= 4).alias("graphic_candidate"), F.col("n").alias("question_count"), F.col("o").alias("structured"), F.col("large").alias("figure_images"), F.greatest(F.lit(0), F.col("taxed") - 1).alias("table_count"), (4 * F.col("r")).alias("numeric_anomalies"))
    return d.select(quality.capability().alias("capability")).groupBy("capability").agg(F.count("*").alias("n"))


@query("batch_facts", "SELECT CASE WHEN contains(text, '%%%') THEN 'skipped' ELSE 'tier' END AS fact, CASE WHEN contains(text, '%%%') THEN source WHEN length(text) > 1000 THEN 'preserved-source' WHEN lang = 'en' THEN 'structured' ELSE 'review-required' END AS value, count(*) AS n FROM documents GROUP BY 1, 2")
def batch_facts(spark, sf):
    """Long texts are documents, junk is a reason to skip."""
    kind = F.when(F.char_length("text") > 1000, "document").otherwise("question")
    d = _docs(spark, sf).select(kind.alias("kind"), F.when(F.col("lang") != "en", "table-review").alias("capability"), F.when(F.col("text").contains("%%%"), F.col("source")).alias("skip_reason"))
    return quality.batch_facts(d)


@query("page_facts", f"SELECT count(*) FILTER (WHERE t > 0) AS known_files, CAST(coalesce(sum(t) FILTER (WHERE t > 0), 0) AS BIGINT) AS pages, CAST(coalesce(sum(greatest(0, least(e, t))) FILTER (WHERE t > 0), 0) AS BIGINT) AS empty, count(*) FILTER (WHERE t > 0 AND (e < 0 OR e > t)) AS odd FROM (SELECT CASE WHEN o THEN n END AS t, large - small AS e FROM ({_OF_ORDER}))")
def page_facts(spark, sf):
    """Orders as files, some of which report nothing and some odd numbers."""
    return quality.page_facts(_of_order(spark, sf).select(F.when(F.col("o"), F.col("n")).alias("total_pages"), (F.col("large") - F.col("small")).alias("empty_pages")))
