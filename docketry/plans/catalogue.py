"""Queries on the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import dates, legal, text
from docketry.operators import graph, html, matching, sampling, sections, stats, tables, vocabulary
from docketry.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "code string, label string")


# ---- lengths and sections of texts


@query("""SELECT lang, count(length(text)) AS n, round(avg(length(text)), 6) AS mean, median(length(text))::DOUBLE AS median, round(stddev_samp(length(text)), 6) AS std FROM documents GROUP BY lang""")
def doc_length_by_lang(spark, d):
    out = stats.length_stats(table(spark, d, "documents"), F.length("text"), "lang")
    return out.select("lang", "n", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"), F.round("std", 6).alias("std"))


@query("""SELECT count(length(coalesce(text, ''))) AS n, round(avg(length(coalesce(text, ''))), 6) AS mean, median(length(coalesce(text, '')))::DOUBLE AS median, round(stddev_samp(length(coalesce(text, ''))), 6) AS std FROM documents""")
def doc_length_overall(spark, d):
    out = stats.length_stats(table(spark, d, "documents"), F.length(F.coalesce("text", F.lit(""))))
    return out.select("n", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"), F.round("std", 6).alias("std"))


@query("""WITH l AS (SELECT unnest(range(len(x))) AS slot, unnest(x) AS line FROM (SELECT string_split(text, chr(10)) AS x FROM documents)), n AS (SELECT count(*) AS total FROM documents)
SELECT 's' || slot AS segment, count(*) FILTER (length(line) > 15) AS n, round(100.0 * count(*) FILTER (length(line) > 15) / any_value(total), 1) AS pct, round(coalesce(avg(length(line)) FILTER (length(line) > 15), 0), 6) AS mean, coalesce(median(length(line)) FILTER (length(line) > 15), 0)::DOUBLE AS median FROM l, n GROUP BY slot""")
def doc_section_presence(spark, d):
    out = stats.slot_stats(table(spark, d, "documents"), F.split("text", "\n"))
    return out.select(F.concat(F.lit("s"), F.col("slot").cast("string")).alias("segment"), "n", "pct", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"))


@query("""WITH x AS (SELECT lang, length(text) AS v FROM documents), q AS (SELECT lang, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY lang)
SELECT lang, q1::DOUBLE AS q1, median::DOUBLE AS median, q3::DOUBLE AS q3, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS low, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS high FROM x JOIN q USING (lang) GROUP BY lang, q1, median, q3""")
def doc_length_box_plot(spark, d):
    return stats.box_plot(table(spark, d, "documents"), F.length("text"), "lang")


@query("""WITH x AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT doc_id, pos, line, last_value(CASE WHEN length(line) < 30 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM x)
SELECT doc_id, coalesce(part, 0)::INTEGER AS part, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM h GROUP BY doc_id, coalesce(part, 0)""")
def section_fold(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = F.last_value(F.when(F.length("line") < 30, F.col("pos") + 1), ignoreNulls=F.lit(True)).over(w)
    return lines.withColumn("part", F.coalesce(part, F.lit(0))).groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(x)))::INTEGER AS pos, unnest(x) AS line FROM (SELECT doc_id, coalesce(string_split(text, chr(10)), [NULL]) AS x FROM documents)),
c AS (SELECT *, (upper(line) = line AND lower(line) <> line AND length(line) > 4) AS capitals FROM l)
SELECT doc_id, CASE WHEN line IS NOT NULL THEN pos END AS pos, CASE WHEN capitals AND length(line) < 150 THEN chr(10) || '## ' || line || chr(10) ELSE regexp_replace(line, '^(\d+\.)\s*(.*)', '**\1** \2') END AS line FROM c""")
def numbered_paragraphs(spark, d):
    # a document without text keeps one row; no line is in bold type
    lines = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", html.markdown_line(F.col("line"), F.lit(False)))


# ---- HTML


@query()
def html_blocks(spark, d):
    found = html.extract(table(spark, d, "pages").select("page_id", "html"))
    return found.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.*")


@query()
def html_headings(spark, d):
    found = html.extract(table(spark, d, "pages").select("page_id", "html"))
    lines = found.select("page_id", F.explode(F.split(html.markdown("blocks"), "\n")).alias("line"))
    return lines.filter(F.col("line").startswith("#"))


@query()
def html_sections(spark, d):
    found = html.extract(table(spark, d, "pages").select("page_id", "html")).withColumn("full_text", html.markdown("blocks"))
    return sections.with_sections(found, "full_text").select("page_id", "full_text", *sections.SECTIONS, F.size("tables").alias("n_tables"), "error")


# ---- lookups, labels, deduplication


@query("""SELECT quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic""")
def label_value_counts(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return stats.value_counts(joined, "quality", "toxic")


@query("""SELECT count(*) AS total, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing, round(100.0 * count(l.doc_id) / count(*), 2) AS pct FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) x LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def label_coverage_pct(spark, d):
    return tables.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_true, round(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 2) AS pct FROM documents GROUP BY lang""")
def long_document_pct(spark, d):
    return stats.conditional_pct(table(spark, d, "documents"), F.col("n_chars") > 1000, "lang")


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def docs_with_labels(spark, d):
    return tables.with_match(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id")


@query("""SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def docs_without_labels(spark, d):
    return tables.without_match(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id")


@query("""SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) ORDER BY doc_id LIMIT 10""")
def first_missing_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("at"))
    return tables.first_missing(docs, table(spark, d, "labels"), "doc_id", "at", 10).select("doc_id")


@query("""SELECT p_partkey, p_type, CASE WHEN regexp_matches(p_type, '(?i)BRASS') THEN 'judgments' WHEN regexp_matches(p_type, '(?i)STEEL') THEN 'decisions' ELSE 'other' END AS kind FROM part""")
def doctype_split(spark, d):
    # the part types play document types: the first word found decides
    as_doctype = F.regexp_replace(F.regexp_replace("p_type", "(?i)BRASS", "JUD"), "(?i)STEEL", "DEC")
    return table(spark, d, "part").select("p_partkey", "p_type", legal.document_kind(as_doctype).alias("kind"))


_PRIORITY = {"1-URGENT": "first", "2-HIGH": "second", "3-MEDIUM": "third"}


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '2-HIGH' THEN 'second' WHEN '3-MEDIUM' THEN 'third' END AS label FROM orders""")
def code_map_priority(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return tables.with_lookup(orders, text.strip("o_orderpriority"), dictionary(spark, _PRIORITY), "label")


@query("""SELECT DISTINCT o_orderpriority AS code FROM orders WHERE o_orderpriority IS NOT NULL EXCEPT SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM'])""")
def code_map_unmatched(spark, d):
    return tables.unmatched(table(spark, d, "orders"), F.col("o_orderpriority"), dictionary(spark, _PRIORITY))


_WORDS_SQL = "string_split(p_name, ' ')"


@query(f"""SELECT p_partkey, array_to_string(list_transform({_WORDS_SQL}, lambda w: CASE w WHEN 'red' THEN 'rouge' WHEN 'blue' THEN 'bleu' WHEN 'green' THEN 'vert' ELSE '[Unmapped: ' || w || ']' END), '|') AS labels FROM part""")
def list_lookup(spark, d):
    labels = legal.mapping({"red": "rouge", "blue": "bleu", "green": "vert"})
    return table(spark, d, "part").select("p_partkey", F.array_join(tables.map_list(F.split("p_name", " "), labels), "|").alias("labels"))


@query(f"""SELECT p_partkey, array_to_string(list_transform({_WORDS_SQL}, lambda w: CASE w WHEN 'red' THEN 'rouge' WHEN 'blue' THEN 'bleu' ELSE '[Unmapped: ' || w || ']' END), '|') AS labels FROM part""")
def list_lookup_by_table(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return tables.map_list_by_table(parts, "p_partkey", "words", dictionary(spark, {"red": "rouge", "blue": "bleu"}), "labels").select("p_partkey", F.array_join("labels", "|").alias("labels"))


@query("""SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, lang, doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_preferred_lang(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "lang")
    return tables.preferred_language(docs, "source", "lang", "doc_id", {"en": 0, "fr": 1})


@query(f"""SELECT item, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS item FROM part) GROUP BY item""")
def explode_token_counts(spark, d):
    return stats.item_counts(table(spark, d, "part"), F.split("p_name", " "))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^0-9/;]+', ';', 'g'), ';+', ';', 'g'), ';') AS appnos FROM pages""")
def clean_numeric_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_appnos("url").alias("appnos"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ;; '), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part""")
def parse_list(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.parse_list(F.replace("p_name", F.lit(" "), F.lit(" ;; "))), "|").alias("items"))


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_concat({_WORDS_SQL}, {_WORDS_SQL}), lambda x: x <> {_WORDS_SQL}[1]), '|') AS items FROM part""")
def list_difference(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.list_difference(F.concat(words, words), F.slice(words, 1, 1)), "|").alias("items"))


@query(r"""WITH n AS (SELECT doc_id, 'CASE OF ' || string_split(text, '.')[1] || CASE WHEN doc_id % 3 = 0 THEN ' v. STATE' WHEN doc_id % 3 = 1 THEN ' c. ETAT' ELSE '' END AS name FROM documents),
m AS (SELECT doc_id, regexp_replace(name, '^(CASE OF|AFFAIRE)\s+', '', 'i') AS name FROM n)
SELECT doc_id, CASE WHEN name <> '' THEN regexp_replace(coalesce(nullif(regexp_extract(name, '(?im)^([^\n]+?)(?:\s*\(v\.\s*| v\.)', 1), ''), nullif(regexp_extract(name, '(?im)^([^\n]+?)\s+c\.', 1), ''), name), '^\s+|\s+$', '', 'g') END AS appellant FROM m""")
def appellant_style_cascade(spark, d):
    party = F.when(F.col("doc_id") % 3 == 0, " v. STATE").when(F.col("doc_id") % 3 == 1, " c. ETAT").otherwise("")
    name = F.concat(F.lit("CASE OF "), F.substring_index("text", ".", 1), party)
    return table(spark, d, "documents").withColumn("name", name).select("doc_id", text.appellant("name").alias("appellant"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Criminal charge' WHEN 1 THEN 'Civil  proceedings' WHEN 2 THEN 'Criminal charge Civil proceedings' WHEN 3 THEN 'Constitutional court' WHEN 4 THEN 'Constitutional court Civil proceedings' WHEN 5 THEN 'Death penalty' ELSE 'None' END AS x FROM documents)
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Criminal' WHEN 1 THEN 'Civil' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'Constitutional' WHEN 4 THEN 'Constitutional' WHEN 5 THEN 'Criminal' ELSE 'Unspecified' END AS limb FROM t""")
def keyword_rule_classify(spark, d):
    k = F.col("doc_id") % 7
    labels = F.when(k == 0, F.array(F.lit("Criminal charge"))).when(k == 1, F.array(F.lit("Civil  proceedings"))).when(k == 2, F.array(F.lit("Criminal charge"), F.lit("Civil proceedings"))).when(k == 3, F.array(F.lit("Constitutional court"))).when(k == 4, F.array(F.lit("Constitutional court"), F.lit("Civil proceedings"))).when(k == 5, F.array(F.lit("Death penalty"))).otherwise(F.array(F.lit("None")))
    return table(spark, d, "documents").select("doc_id", legal.limb(labels).alias("limb"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'Mixed' END AS flag FROM lineitem GROUP BY l_orderkey""")
def set_collapse_mixed(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", legal.collapse("flags").alias("flag"))


# ---- years, periods, samples


@query("""SELECT o_orderkey, coalesce(try_cast(left(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, 4) AS INTEGER), try_cast(regexp_extract('ECLI:X:' || year(o_orderdate) || ':01', ':(\\d{4}):', 1) AS INTEGER)) AS year FROM orders""".replace("\\\\", "\\"))
def coalesce_year(spark, d):
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    ecli = F.concat(F.lit("ECLI:X:"), F.year("o_orderdate").cast("string"), F.lit(":01"))
    return table(spark, d, "orders").withColumns({"date": date, "ecli": ecli}).select("o_orderkey", dates.case_year("date", "ecli").alias("year"))


_PERIOD = "CASE WHEN y <= 1964 THEN '1959-1964' WHEN y >= 2020 THEN '2020-2025' ELSE (1965 + 5 * ((y - 1965) // 5)) || '-' || (1969 + 5 * ((y - 1965) // 5)) END"


@query(f"""SELECT {_PERIOD} AS period, count(*) AS n FROM (SELECT year(o_orderdate) + (o_orderkey % 60)::INTEGER - 36 AS y FROM orders) GROUP BY ALL""")
def period_bins(spark, d):
    y = F.year("o_orderdate") + (F.col("o_orderkey") % 60).cast("int") - 36
    return stats.value_counts(table(spark, d, "orders").select(dates.period(y).alias("period")), "period")


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH x AS (SELECT year(o_orderdate) AS year, n_name AS nation FROM {_ORDERS}), g AS (SELECT DISTINCT x.year, n.n_name AS nation FROM x CROSS JOIN nation n), c AS (SELECT year, nation, count(*) AS n FROM x GROUP BY ALL)
SELECT g.year, g.nation, coalesce(c.n, 0) AS n, round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.year), 6) AS share FROM g LEFT JOIN c ON g.year = c.year AND g.nation = c.nation""")
def period_nation_grid_share(spark, d):
    nation = table(spark, d, "nation")
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    x = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("year", F.col("n_name").alias("nation"))
    grid = tables.grid_counts(x, x, nation.select(F.col("n_name").alias("nation")), "year", "nation")
    return grid.withColumn("share", F.round("share", 6))


@query("""WITH c AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT segment, year, n, round(n / sum(n) OVER (PARTITION BY segment), 9) AS share FROM c""")
def yearly_share_by_segment(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = stats.value_counts(joined.select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year")), "segment", "year")
    return stats.shares(counts, ["segment"]).withColumn("share", F.round("share", 9))


_SAMPLE = """SELECT o_orderkey, o_orderpriority, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
WHERE n <= 50 OR list_contains(list_transform(range(50), lambda i: CASE WHEN i = 49 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 49.0))::BIGINT END), pos)"""


@query(_SAMPLE)
def time_spread_sample(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return sampling.time_spread_sample(orders, "o_orderpriority", "o_orderdate", "o_orderkey", k=50)


@query(f"""WITH s AS ({_SAMPLE}), f AS (SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS least, max(o_orderdate) AS greatest FROM orders GROUP BY 1), t AS (SELECT o_orderpriority, count(*) AS n_sample, min(o_orderdate) AS least_sample, max(o_orderdate) AS greatest_sample FROM s GROUP BY 1) SELECT * FROM f LEFT JOIN t USING (o_orderpriority)""")
def sample_vs_full_summary(spark, d):
    full = stats.group_range(table(spark, d, "orders"), "o_orderdate", "o_orderpriority")
    sample = stats.group_range(time_spread_sample(spark, d), "o_orderdate", "o_orderpriority").withColumnsRenamed({"n": "n_sample", "least": "least_sample", "greatest": "greatest_sample"})
    return full.join(sample, "o_orderpriority", "left")


@query("""WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), l AS (SELECT list_sort(list(n)) AS x, count(*) AS k FROM c) SELECT x[1] AS least, x[1 + floor((k - 1) * 0.25)::BIGINT] AS q25, x[1 + floor((k - 1) * 0.5)::BIGINT] AS q50, x[1 + floor((k - 1) * 0.75)::BIGINT] AS q75, x[-1] AS greatest FROM l""")
def lower_rank_quantiles(spark, d):
    counts = stats.value_counts(table(spark, d, "orders"), "o_custkey")
    return stats.lower_rank_quantiles(counts, "n")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 25)::INTEGER + 1, 25) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def histogram_25(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 25)


@query("""SELECT * FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_partkey LIMIT 20""")
def top_counts(spark, d):
    return stats.top(stats.value_counts(table(spark, d, "lineitem"), "l_partkey"), 20, "l_partkey")


# ---- unions, joins


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def relaxed_union_cases(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tables.relaxed_union(customers, suppliers)


@query()
def fuzzy_best_match(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    asked = names.select(F.regexp_replace("p_name", "[aeiou](?=[a-z])", "").alias("name")).union(names.select(F.upper("p_name")))
    # ids by hash: a running number would put all names in one task
    reference = names.select(F.xxhash64("p_name").alias("judge_id"), F.col("p_name").alias("name"))
    return matching.best_matches(asked, reference).withColumn("score", F.round("score", 9))


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT DISTINCT a.l_orderkey AS citing, b.l_orderkey AS cited FROM x a JOIN x b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey <> b.l_orderkey""")
def citation_self_join(spark, d):
    # every order plays a citing case and a cited one
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("value"))
    return tables.citations(x, x)


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(length(text) ORDER BY turn) FILTER (turn > 0) AS b FROM conversations GROUP BY conv_id), u AS (SELECT conv_id, a, b, unnest(range(greatest(len(a), coalesce(len(b), 0)))) AS pos FROM l) SELECT conv_id, pos::INTEGER AS pos, a[pos + 1] AS role, b[pos + 1]::INTEGER AS chars FROM u""")
def ragged_zip(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars"))))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("x"))
    a = F.transform("x", lambda r: r["role"])
    b = F.transform(F.filter("x", lambda r: r["turn"] > 0), lambda r: r["chars"])
    return lists.select("conv_id", F.posexplode(tables.ragged_zip(a, b)).alias("pos", "z")).select("conv_id", "pos", F.col("z.a").alias("role"), F.col("z.b").alias("chars"))


@query("""SELECT s_suppkey, coalesce(n.n_name, r.r_name) AS place FROM supplier LEFT JOIN nation n ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region r ON r_name = CASE s_nationkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END""")
def ordered_fallback_lookup(spark, d):
    key = F.col("s_nationkey") % 5
    name = F.when(key == 0, "AFRICA").when(key == 1, "AMERICA").when(key == 2, "ASIA").when(key == 3, "EUROPE").otherwise("MIDDLE EAST")
    asked = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", name.alias("region_name"))
    by_id = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select("n_nationkey", F.col("n_name").alias("place"))
    by_name = table(spark, d, "region").select("r_name", F.col("r_name").alias("place"))
    by_id, by_name = by_id.withColumnRenamed("n_nationkey", "s_nationkey"), by_name.withColumnRenamed("r_name", "region_name")
    return tables.ordered_fallback(asked, by_id, by_name, "s_nationkey", "region_name", "place").select("s_suppkey", "place")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_tolerant(spark, d):
    from pyspark.sql.types import LongType, StructField, StructType

    events = table(spark, d, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "note": "a\\N", '), F.substring("props", 2, 1_000_000)).alias("line"))
    schema = StructType([StructField("event_id", LongType()), StructField("k", LongType())])
    return readers.parse_tolerant(events, "line", schema)


@query("""SELECT 'customer' AS dataset, 'c_custkey' AS "column", 'bigint' AS dtype UNION ALL SELECT 'customer', 'c_name', 'string' UNION ALL SELECT 'customer', 'c_nationkey', 'int' UNION ALL SELECT 'customer', 'c_acctbal', 'double' UNION ALL SELECT 'customer', 'c_mktsegment', 'string' UNION ALL SELECT 'nation', 'n_nationkey', 'int' UNION ALL SELECT 'nation', 'n_name', 'string' UNION ALL SELECT 'nation', 'n_regionkey', 'int'""")
def schema_as_table(spark, d):
    return tables.schema_table({n: table(spark, d, n) for n in ("customer", "nation")})


@query("""WITH u AS (SELECT lang, count(*) AS documents, sum(n_chars) / 4.0 / count(*) AS tokens_in, 500.0 AS tokens_out FROM documents GROUP BY lang), p(model, price_in, price_cached, price_out) AS (VALUES ('small', 0.25, 0.025, 2.0), ('large', 1.25, 0.125, 10.0)), c(scenario, cached_share) AS (VALUES ('cold', 0.0), ('warm', 0.6))
SELECT lang, model, scenario, round_even((tokens_in * (1 - cached_share) * price_in + tokens_in * cached_share * price_cached + tokens_out * price_out) / 1000000 * documents, 2)::DOUBLE AS cost_total FROM u, p, c""")
def corpus_cost_model(spark, d):
    usage = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), (F.sum("n_chars") / F.lit(4.0) / F.count(F.lit(1))).alias("tokens_in"), F.lit(500.0).alias("tokens_out"))
    models = spark.createDataFrame([("small", 0.25, 0.025, 2.0), ("large", 1.25, 0.125, 10.0)], "model string, price_in double, price_cached double, price_out double")
    scenarios = spark.createDataFrame([("cold", 0.0), ("warm", 0.6)], "scenario string, cached_share double")
    return tables.cost_model(usage, models, scenarios).select("lang", "model", "scenario", "cost_total")


# ---- triples


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and orders as triples."""
    region, nation, customer, orders = (table(spark, d, n) for n in ("region", "nation", "customer", "orders"))
    key = lambda kind, c: graph.iri(kind, F.col(c).cast("string"))
    parts = [
        graph.melt(region, key("region", "r_regionkey"), graph.edge(graph.TYPE, graph.term("Region"), schema=False), graph.literal("name", F.col("r_name"))),
        graph.melt(nation, key("nation", "n_nationkey"), graph.edge(graph.TYPE, graph.term("Nation"), schema=False), graph.literal("name", F.col("n_name")), graph.edge("inRegion", key("region", "n_regionkey"))),
        graph.melt(customer, key("customer", "c_custkey"), graph.edge(graph.TYPE, graph.term("Customer"), schema=False), graph.literal("name", F.col("c_name")), graph.edge("inNation", key("nation", "c_nationkey"))),
        graph.melt(orders, key("order", "o_orderkey"), graph.edge(graph.TYPE, graph.term("Order"), schema=False), graph.literal("status", F.col("o_orderstatus")), graph.edge("byCustomer", key("customer", "o_custkey"))),
    ]
    return graph.union(*parts)


def _node_sql(kind: str, c: str) -> str:
    return f"'{graph.DATA}{kind}_' || {c}"


def _part_sql(rel: str, kind: str, c: str, cls: str, name: tuple[str, str], link: tuple[str, str, str] | None) -> str:
    s = _node_sql(kind, c)
    parts = [f"SELECT {s} AS s, '{graph.TYPE}' AS p, '{graph.SCHEMA}{cls}' AS o, 'iri' AS o_kind FROM {rel}", f"SELECT {s}, '{graph.SCHEMA}{name[0]}', {name[1]}, 'literal' FROM {rel}"]
    if link:
        parts.append(f"SELECT {s}, '{graph.SCHEMA}{link[0]}', {_node_sql(link[1], link[2])}, 'iri' FROM {rel}")
    return " UNION ".join(parts)


_TRIPLES = "t AS (" + " UNION ".join([
    _part_sql("region", "region", "r_regionkey", "Region", ("name", "r_name"), None),
    _part_sql("nation", "nation", "n_nationkey", "Nation", ("name", "n_name"), ("inRegion", "region", "n_regionkey")),
    _part_sql("customer", "customer", "c_custkey", "Customer", ("name", "c_name"), ("inNation", "nation", "c_nationkey")),
    _part_sql("orders", "order", "o_orderkey", "Order", ("status", "o_orderstatus"), ("byCustomer", "customer", "o_custkey")),
]) + ")"
_EDGES = "e AS (SELECT s AS src, o AS dst, p AS label FROM t WHERE o_kind = 'iri')"
_TOP = "k AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 10)"


@query(f"WITH {_TRIPLES} SELECT s, p, o, o_kind FROM t")
def to_triples(spark, d):
    return _triples(spark, d).select("s", "p", "o", "o_kind")


@query(f"WITH {_TRIPLES} SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o || o_kind) AS objects, count(DISTINCT s) AS iri_subjects, 0::BIGINT AS blank_subjects, count(DISTINCT o) FILTER (o_kind = 'literal') AS literal_objects FROM t")
def triple_profile(spark, d):
    return graph.statistics(_triples(spark, d))


@query(f"WITH {_TRIPLES} SELECT o AS class, count(DISTINCT s) AS n FROM t WHERE p = '{graph.TYPE}' GROUP BY o")
def class_counts(spark, d):
    return graph.class_counts(_triples(spark, d))


@query(f"WITH {_TRIPLES} SELECT p, count(*) AS n FROM t GROUP BY p ORDER BY n DESC, p LIMIT 5")
def predicate_topk(spark, d):
    return stats.top(graph.predicate_counts(_triples(spark, d)), 5, "p")


@query(f"WITH {_TRIPLES} SELECT s, count(*) AS n FROM t GROUP BY s")
def out_degree(spark, d):
    return graph.out_degrees(_triples(spark, d))


@query(f"WITH {_TRIPLES} SELECT s, p, array_to_string(list_sort(list(DISTINCT o)), '|') AS vals FROM t GROUP BY s, p")
def case_audit(spark, d):
    return graph.audit(_triples(spark, d)).select("s", "p", F.array_join("values", "|").alias("vals"))


_G = f"CASE WHEN s LIKE '{graph.DATA}order_%' THEN 'orders' ELSE 'master' END"


@query(f"WITH {_TRIPLES} SELECT {_G} AS g, count(*) AS n FROM t GROUP BY 1")
def quads_by_graph(spark, d):
    g = F.when(F.col("s").startswith(graph.DATA + "order_"), "orders").otherwise("master")
    return graph.graph_counts(_triples(spark, d).withColumn("g", g))


@query(f"WITH {_TRIPLES}, {_EDGES}, {_TOP} SELECT src, dst, label FROM e WHERE src IN (SELECT node FROM k) OR (dst IN (SELECT node FROM k))")
def one_hop_neighbourhood(spark, d):
    e = graph.edges(_triples(spark, d))
    return graph.neighbourhood(e, graph.top_nodes(e, 10))


@query(f"WITH {_TRIPLES}, {_EDGES}, {_TOP} SELECT src, dst, label FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def degree_topk_subgraph(spark, d):
    e = graph.edges(_triples(spark, d))
    return graph.induced(e, graph.top_nodes(e, 10))


@query(f"WITH {_TRIPLES}, {_EDGES} SELECT src, dst, string_agg(DISTINCT label, chr(10) ORDER BY label) AS labels FROM e GROUP BY src, dst")
def edge_label_groups(spark, d):
    return graph.edge_labels(graph.edges(_triples(spark, d)))


@query(f"WITH {_TRIPLES} SELECT p AS term, 'predicate' AS role, count(*) AS n FROM t WHERE p LIKE '{graph.SCHEMA}%' AND p NOT IN ('{graph.SCHEMA}name', '{graph.SCHEMA}inNation') GROUP BY p UNION ALL SELECT o, 'class', count(*) FROM t WHERE p = '{graph.TYPE}' AND o <> '{graph.SCHEMA}Order' GROUP BY o")
def schema_gate_undeclared(spark, d):
    declared = spark.createDataFrame([(graph.SCHEMA + n,) for n in ("name", "inNation", "Order")], "term string")
    return graph.undeclared(_triples(spark, d), declared)


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t WHERE p IN ('{graph.SCHEMA}name', '{graph.SCHEMA}inNation') OR (p = '{graph.TYPE}' AND o = '{graph.SCHEMA}Order')")
def schema_gate_declared(spark, d):
    declared = spark.createDataFrame([(graph.SCHEMA + n,) for n in ("name", "inNation", "Order")], "term string")
    return graph.declared_only(_triples(spark, d), declared).select("s", "p", "o")


@query()
def vocabulary_edges(spark, d):
    return graph.edge_labels(graph.domain_range_edges(vocabulary.triples(spark)))
