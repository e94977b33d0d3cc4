"""Layout, page statistics and quality gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, stats
from .views import LINES, WORDS, lines, table, words


def line_reading_order_text1d(spark, d):
    return layout.reading_text(words(spark, d, by_page=True)).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n"))


def line_height_density(spark, d):
    return layout.line_height_and_density(words(spark, d)).select("page_id", "line_height", F.round("char_density", 6).alias("char_density"))


def layout_line_islands(spark, d):
    r = layout.line_islands(words(spark, d, by_page=True))
    return r.groupBy("page_id", "line_no").agg(F.count("*").alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"))


def layout_newlines(spark, d):
    """Newlines before each line by the gap to the lines above."""
    per = layout.line_islands(words(spark, d, by_page=True)).groupBy("page_id", "line_no").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"))
    gap = F.col("top") - F.lag("bottom").over(Window.partitionBy("page_id").orderBy("line_no"))
    return per.select("page_id", "line_no", F.when(gap.isNull(), 0).when(gap < 40, 1).otherwise(2).alias("newlines"))


def text2d(spark, d):
    w = words(spark, d, by_page=True)
    return layout.layout_text(layout.line_islands(w), layout.line_height_and_density(w))


def word_line_cluster(spark, d):
    return layout.line_counts(words(spark, d), layout.anchored_groups)


def moving_line_cluster(spark, d):
    return layout.line_counts(words(spark, d), layout.moving_clusters)


def merged_word_lines(spark, d):
    w = words(spark, d, by_page=True).withColumn("confidence", 1 / (1 + F.col("j")))
    return layout.merged_lines(w, group="line").select("page_id", "line", "text", "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"))


def paragraph_rollup(spark, d):
    return layout.rollup(words(spark, d, by_page=True).withColumn("paragraph", F.floor(F.col("line") / 4)), ["page_id", "paragraph"], ["idx"])


def block_rollup(spark, d):
    b = lines(spark, d).withColumn("block", F.floor(F.col("line") / 3))
    return b.groupBy("page_id", "block").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("line_ids"), F.lit("body").alias("region"))


def degenerate_filter(spark, d):
    kept, w = layout.drop_degenerate(lines(spark, d), words(spark, d, by_page=True), 2000)
    a = kept.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.max("new_line").alias("last_line"))
    return a.join(w.groupBy("page_id").agg(F.count("*").alias("n_words"), F.max("new_word").alias("last_word")), "page_id", "left")


def _layout(spark, d):
    ln = lines(spark, d).withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1"))
    r = lambda c, n: F.round(c, 6).alias(n)
    s = ln.groupBy("page_id").agg(F.count("*").alias("lines"), F.sum("parts").alias("words"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), r(F.avg("w"), "mean_w"), r(F.coalesce(F.stddev_samp("w"), F.lit(0.0)), "std_w"), r(F.avg(F.col("w") / F.col("h")), "aspect"), r(F.avg((F.col("x1") + F.col("x2")) / 2), "centre"))
    return s.withColumn("words_per_line", F.round(F.col("words") / F.col("lines"), 6))


_LAYOUT = LINES + """, layout AS (SELECT page_id, count(*) AS lines, sum(parts)::BIGINT AS words, min(x2 - x1) AS min_w, max(x2 - x1) AS max_w, round(avg(x2 - x1), 6) AS mean_w, round(coalesce(stddev_samp(x2 - x1), 0), 6) AS std_w,
 round(avg((x2 - x1) / (y2 - y1)), 6) AS aspect, round(avg((x1 + x2) / 2), 6) AS centre, round(sum(parts) / count(*), 6) AS words_per_line FROM lines GROUP BY 1)"""
_METRICS = ["lines", "words", "min_w", "max_w", "mean_w", "std_w", "aspect", "centre", "words_per_line"]
_RULES = [("lines", ">", 30), ("max_w", ">", 4000), ("std_w", "<", 50), ("words_per_line", ">=", 40), ("aspect", ">", 120)]
_BAD = " OR ".join(f"coalesce({m} {o} {v}, false)" for m, o, v in _RULES)


def sample_layout_stats(spark, d):
    return _layout(spark, d)


def metric_unpivot_summary(spark, d):
    return stats.summaries(_layout(spark, d), _METRICS)


def percentile_report(spark, d):
    return stats.percentiles(_layout(spark, d), _METRICS)


def filter_impact(spark, d):
    return stats.impact(_layout(spark, d), _RULES)


def quality_gate(spark, d):
    return _layout(spark, d).select("page_id", (~stats.violates(_RULES)).alias("passes"))


def problematic_topk(spark, d):
    return _layout(spark, d).where(stats.violates(_RULES)).orderBy(F.desc("max_w"), "page_id").limit(20).select("page_id", "max_w")


def global_totals(spark, d):
    s = _layout(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "source"), "page_id")
    return s.agg(F.count("*").alias("pages"), F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.count_distinct("source").alias("sources"), F.round(100 * F.count_if(F.expr("lines > 30")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("pct_long"))


def metric_rollup(spark, d):
    """Mean lengths by language and source, with totals."""
    g = table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return g


def visual_tokens(spark, d):
    ext = words(spark, d).groupBy("page_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    return ext.select("page_id", (F.floor(F.col("w") / 28) * F.floor(F.col("h") / 28)).alias("visual_tokens"))


def page_id_pad(spark, d):
    last = F.max("line").over(Window.partitionBy("page_id"))
    return lines(spark, d).select("page_id", "line", T.page_name(F.col("line"), last).alias("name"))


def position_zip(spark, d):
    """Texts and boxes paired by position, cut at the shorter list."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", " ").alias("a"), F.split("text", "\n").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    z = docs.select("page_id", F.posexplode(F.arrays_zip(F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(1), n).alias("b"))).alias("i", "z"))
    return z.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("z.a") * F.length("z.b")).alias("cross"))


QUERIES = {f.__name__: f for f in (line_reading_order_text1d, line_height_density, layout_line_islands, layout_newlines, text2d, word_line_cluster, moving_line_cluster, merged_word_lines, paragraph_rollup, block_rollup, degenerate_filter, sample_layout_stats, metric_unpivot_summary, percentile_report, filter_impact, quality_gate, problematic_topk, global_totals, metric_rollup, visual_tokens, page_id_pad, position_zip)}

_UNPIVOT = "(" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM layout" for m in _METRICS) + ")"
_HULL = "min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2"
SQL = {
    "line_reading_order_text1d": f"WITH {WORDS} SELECT page_id, md5(string_agg(trim(text), ' ' ORDER BY y1, x1, idx)) AS text_md5, length(string_agg(trim(text), ' ' ORDER BY y1, x1, idx))::INT AS n FROM words GROUP BY 1",
    "line_height_density": f"WITH {WORDS} SELECT page_id, min(y2 - y1) AS line_height, round(quantile_cont(length(text) / (x2 - x1), 0.8), 6) AS char_density FROM words WHERE trim(text) <> '' GROUP BY 1",
    "layout_line_islands": f"WITH {WORDS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY line) AS line_no FROM words) SELECT page_id, line_no, count(*) AS n, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1 FROM r GROUP BY 1, 2",
    "layout_newlines": f"WITH {LINES}, g AS (SELECT page_id, row_number() OVER w AS line_no, y1 - lag(y2) OVER w AS gap FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY line)) SELECT page_id, line_no, CASE WHEN gap IS NULL THEN 0 WHEN gap < 40 THEN 1 ELSE 2 END AS newlines FROM g",
    "word_line_cluster": f"WITH {WORDS} SELECT page_id, count(DISTINCT line) AS n_lines FROM words GROUP BY 1",
    "moving_line_cluster": f"WITH {WORDS} SELECT page_id, count(DISTINCT line) AS n_lines FROM words GROUP BY 1",
    "merged_word_lines": f"WITH {WORDS} SELECT page_id, line, string_agg(text, ' ' ORDER BY x1, idx) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, min(y2) AS y2, round(avg(1 / (1 + j)), 6) AS confidence FROM words GROUP BY 1, 2",
    "paragraph_rollup": f"WITH {WORDS} SELECT page_id, line // 4 AS paragraph, string_agg(text, ' ' ORDER BY idx) AS text, {_HULL}, count(*) AS parts FROM words GROUP BY 1, 2",
    "block_rollup": f"WITH {LINES} SELECT page_id, line // 3 AS block, {_HULL}, string_agg(line::VARCHAR, ',' ORDER BY line) AS line_ids, 'body' AS region FROM lines GROUP BY 1, 2",
    "degenerate_filter": f"WITH {LINES}, k AS (SELECT * FROM lines WHERE (x2 - x1) * (y2 - y1) >= 2000) SELECT page_id, n_lines, n_lines - 1 AS last_line, n_words, n_words - 1 AS last_word FROM (SELECT page_id, count(*) AS n_lines, sum(parts)::BIGINT AS n_words FROM k GROUP BY 1)",
    "sample_layout_stats": f"WITH {_LAYOUT} SELECT * FROM layout",
    "metric_unpivot_summary": f"WITH {_LAYOUT} SELECT metric, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM {_UNPIVOT} GROUP BY 1",
    "percentile_report": f"WITH {_LAYOUT}, p AS (SELECT unnest([0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1])::DOUBLE AS p, unnest(range(1, 9)) AS i), q AS (SELECT metric, quantile_cont(value, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]) AS v FROM {_UNPIVOT} GROUP BY 1) SELECT metric, p, round(v[i], 6) AS value FROM q, p",
    "filter_impact": f"WITH {_LAYOUT} " + " UNION ALL ".join(f"SELECT '{m} {o} {v}' AS rule, count(*) FILTER ({m} {o} {v}) AS n_hit FROM layout" for m, o, v in _RULES),
    "quality_gate": f"WITH {_LAYOUT} SELECT page_id, NOT ({_BAD}) AS passes FROM layout",
    "problematic_topk": f"WITH {_LAYOUT} SELECT page_id, max_w FROM layout WHERE {_BAD} ORDER BY max_w DESC, page_id LIMIT 20",
    "global_totals": f"WITH {_LAYOUT} SELECT count(*) AS pages, sum(lines)::BIGINT AS lines, sum(words)::BIGINT AS words, count(DISTINCT source) AS sources, round(100 * count(*) FILTER (lines > 30) / greatest(count(*), 1), 6) AS pct_long FROM layout JOIN documents ON doc_id = page_id",
    "metric_rollup": "SELECT lang, source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)",
    "visual_tokens": f"WITH {WORDS} SELECT page_id, (max(x2) // 28) * (max(y2) // 28) AS visual_tokens FROM words GROUP BY 1",
    "page_id_pad": f"WITH {LINES} SELECT page_id, line, lpad(line::VARCHAR, greatest(4, length((max(line) OVER (PARTITION BY page_id))::VARCHAR))::INT, '0') AS name FROM lines",
    "position_zip": "WITH z AS (SELECT doc_id AS page_id, string_split(text, ' ') AS a, string_split(text, chr(10)) AS b FROM documents), u AS (SELECT page_id, unnest(a[1:least(len(a), len(b))]) AS x, unnest(b[1:least(len(a), len(b))]) AS y FROM z) SELECT page_id, count(*) AS n, sum(length(x) * length(y))::BIGINT AS \"cross\" FROM u GROUP BY 1",
}
