"""Text scoring, cleaning, markup and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assignment, tasks
from .views import TURNS, table, turns

KEYS = ["conv_id", "turn"]


def text_em(spark, d):
    return turns(spark, d).select(*KEYS, (F.col("expected") == F.col("predicted")).cast("int").alias("exact_match"))


def text_cer(spark, d):
    return turns(spark, d).select(*KEYS, F.round(T.distance_rate(F.col("expected"), F.col("predicted")), 6).alias("cer"))


def text_anls(spark, d):
    return turns(spark, d).select(*KEYS, F.round(T.anls(F.col("expected"), F.col("predicted")), 6).alias("anls"))


def text_wer(spark, d):
    return turns(spark, d).select(*KEYS, F.round(T.word_error_rate(F.col("expected"), F.col("predicted")), 6).alias("wer"))


def text_reading_metrics(spark, d):
    c = table(spark, d, "conversations")
    return c.select(*KEYS, T.reading_metrics(F.col("text"), F.replace("text", F.lit("th"), F.lit("ht"))).alias("m")).select(*KEYS, "m.*")


def text_summary_by_role(spark, d):
    """Macro means and medians by the role that speaks."""
    e, p, distance = F.col("expected"), F.col("predicted"), F.col("distance")
    m = turns(spark, d).withColumn("distance", F.levenshtein(e, p)).select("role", (e == p).cast("double").alias("em"), T.distance_rate(e, p, distance).alias("cer"), T.anls(e, p, distance=distance).alias("anls"))
    return m.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.median("cer"), 6).alias("median_cer"), F.round(F.avg("anls"), 6).alias("mean_anls")).orderBy("role")


# DuckDB's distance counts bytes: characters beyond ASCII become control characters first, one for each
_ABROAD = "ÄÖÜäöüßÇçÉéÊêÈèÍíÑñÓóÚúÁáàâ"
_PLAIN = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32), 127][: len(_ABROAD)])
_DISTANCE = f"levenshtein(translate(expected, '{_ABROAD}', {_PLAIN}), translate(predicted, '{_ABROAD}', {_PLAIN}))"
_CER = f"CASE WHEN greatest(length(expected), length(predicted)) = 0 THEN 0.0 WHEN length(expected) = 0 THEN 1.0 ELSE {_DISTANCE} / greatest(length(expected), length(predicted)) END"
_ANLS = f"CASE WHEN length(expected) = 0 AND length(predicted) = 0 THEN 1.0 WHEN length(expected) = 0 OR length(predicted) = 0 THEN 0.0 WHEN {_DISTANCE} / greatest(length(expected), length(predicted)) < 0.5 THEN 1 - {_DISTANCE} / greatest(length(expected), length(predicted)) ELSE 0.0 END"


def text_clean(spark, d):
    t = T.squeeze(T.ascii_only(F.col("text")))
    return table(spark, d, "documents").select("doc_id", t.alias("clean"), F.size(T.words(t)).alias("n_words"), T.cut_at_word(t, 80).alias("head"))


def text_nfc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize("NFC")(F.col("text")).alias("text"))


def text_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize("NFKC")(F.col("text")).alias("text"))


def text_cjk(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_cjk(F.col("text")).alias("cjk"))


def placeholder_mark(spark, d):
    mark = T.has_placeholder(F.col("question"))
    return turns(spark, d).select(*KEYS, mark.alias("is_template"), F.when(~mark, F.round(T.distance_rate(F.col("expected"), F.col("predicted")), 6)).alias("cer"))


def placeholder_drop(spark, d):
    return turns(spark, d).where(~T.has_placeholder(F.col("question"))).groupBy("role").agg(F.count("*").alias("n"))


def predicted_text_extract(spark, d):
    e = table(spark, d, "events")
    out = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"text": "'), "event_type", F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('[{"answer": "'), "event_type", F.lit('", "k": 1}]'))).otherwise(F.concat(F.lit("no json: "), "event_type"))
    return e.select("event_id", T.predicted_text(out).alias("text"))


def props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.count_distinct(k).alias("kinds"))


def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def html_md_classify(spark, d):
    h, m = (table(spark, d, n) for n in ("pages", "documents"))
    x = h.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t")).unionByName(m.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t")))
    return x.select("kind", "id", T.looks_html(F.col("t")).alias("html"), T.looks_markdown(F.col("t")).alias("markdown"))


def token_multiset_f1(spark, d):
    """Overlap of token bags: counts of each side by token, then sums of the smaller and the larger."""
    t = turns(spark, d)
    bag = lambda c, n: t.select(*KEYS, F.explode(T.tokens(F.col(c))).alias("token")).groupBy(*KEYS, "token").agg(F.count("*").alias(n))
    both = bag("expected", "e").join(bag("predicted", "p"), [*KEYS, "token"], "full").fillna(0, ["e", "p"])
    s = both.groupBy(*KEYS).agg(F.sum(F.least("e", "p")).alias("m"), F.sum(F.greatest("e", "p")).alias("u"), F.sum("e").alias("ne"), F.sum("p").alias("np"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * F.col("m"), F.col("ne") + F.col("np")), F.lit(0.0))
    return s.select(*KEYS, F.round(ratio("m", "np"), 6).alias("precision"), F.round(ratio("m", "ne"), 6).alias("recall"), F.round(f, 6).alias("f1"), F.round(ratio("m", "u"), 6).alias("jaccard"))


def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct"))


def ned(spark, d):
    return turns(spark, d).groupBy("role").agg(F.round(F.avg(T.distance_rate(F.lower(F.col("expected")), F.lower(F.col("predicted")))), 6).alias("ned"))


def qa_accuracy(spark, d):
    return turns(spark, d).groupBy("role").agg(F.round(F.avg((F.lower(F.col("expected")) == F.lower(F.replace(F.col("predicted"), F.lit("ht"), F.lit("th")))).cast("int")), 6).alias("accuracy"))


def rouge_l(spark, d):
    return turns(spark, d).select("role", T.rouge_l(F.col("expected"), F.col("predicted")).alias("r")).groupBy("role").agg(*(F.round(F.avg(f"r.{c}"), 6).alias(c) for c in ("recall", "precision", "f")))


def soft_token_f1(spark, d):
    t = turns(spark, d).select(F.concat_ws("/", *KEYS).alias("id"), T.tokens(F.col("expected")).alias("e"), T.tokens(F.col("predicted")).alias("p"))
    return assignment.soft_matches(t, "id", "e", "p").select("id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def conversation_prompt_pairs(spark, d):
    return tasks.next_turn(table(spark, d, "conversations"), "conv_id", "turn")


def latex_fixups(spark, d):
    """Brace balance and common repairs of source text, over benchmark items."""
    t = F.replace(F.replace("text", F.lit("e"), F.lit("{e")), F.lit("\\\\"), F.lit("\\"))
    opens, closes = (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "{}")
    return table(spark, d, "benchmark").select("item_id", F.concat(t, F.repeat(F.lit("}"), F.greatest(F.lit(0), opens - closes))).alias("latex"))


QUERIES = {f.__name__: f for f in (text_em, text_cer, text_anls, text_wer, text_reading_metrics, text_summary_by_role, text_clean, text_nfc, text_nfkc, text_cjk, placeholder_mark, placeholder_drop, predicted_text_extract, props_json, html_strip, html_md_classify, token_multiset_f1, token_counts, ned, qa_accuracy, rouge_l, soft_token_f1, conversation_prompt_pairs, latex_fixups)}

_TOKEN = r"\p{L}+(?:[''’-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*"
_HTML = r"(?i)</?(html|body|div|p|span|table|tr|td|th|ul|ol|li|br|h[1-6]|a|img|script|style)\b[^>]*>"
_MD = " + ".join(f"regexp_matches(t, '{p}')::INT" for p in (r"(?m)^#{1,6} ", r"(?m)^\s*[-*+] \S", r"(?m)^\s*[0-9]+\. ", r"\*\*[^*\n]+\*\*", r"\[[^\]\n]+\]\([^)\n]+\)", r"(?m)^\|.*\|$", r"```"))
_STRIP = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"

SQL = {
    "text_em": f"WITH {TURNS} SELECT conv_id, turn, (expected = predicted)::INT AS exact_match FROM turns",
    "text_cer": f"WITH {TURNS} SELECT conv_id, turn, round({_CER}, 6) AS cer FROM turns",
    "text_anls": f"WITH {TURNS} SELECT conv_id, turn, round({_ANLS}, 6) AS anls FROM turns",
    "text_summary_by_role": f"WITH {TURNS}, m AS (SELECT role, (expected = predicted)::DOUBLE AS em, {_CER} AS cer, {_ANLS} AS anls FROM turns) SELECT role, count(*) AS n, round(avg(em), 6) AS em, round(avg(cer), 6) AS mean_cer, round(median(cer), 6) AS median_cer, round(avg(anls), 6) AS mean_anls FROM m GROUP BY role ORDER BY role",
    "text_clean": r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents)
SELECT doc_id, clean, len(list_filter(string_split(clean, ' '), lambda x: x <> ''))::INT AS n_words, CASE WHEN length(clean) <= 80 THEN clean ELSE regexp_replace(substr(clean, 1, 80), ' [^ ]*$', '') END AS head FROM c""",
    "text_nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "text_cjk": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]') AS cjk FROM documents",
    "placeholder_mark": f"WITH {TURNS} SELECT conv_id, turn, contains(question, '{{text}}') AS is_template, CASE WHEN NOT contains(question, '{{text}}') THEN round({_CER}, 6) END AS cer FROM turns",
    "placeholder_drop": f"WITH {TURNS} SELECT role, count(*) AS n FROM turns WHERE NOT contains(question, '{{text}}') GROUP BY role",
    "predicted_text_extract": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'no json: ' || event_type ELSE event_type END AS text FROM events",
    "props_json": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, count(DISTINCT k) AS kinds FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "html_strip": rf"SELECT page_id, trim(regexp_replace({_STRIP}, '[\s\x{{a0}}]+', ' ', 'g')) AS text FROM pages",
    "html_md_classify": f"WITH x AS (SELECT 'page' AS kind, page_id AS id, coalesce(html, '') AS t FROM pages UNION ALL SELECT 'document', doc_id, coalesce(text, '') FROM documents) SELECT kind, id, regexp_matches(t, '{_HTML}') AS html, ({_MD}) >= 2 AS markdown FROM x",
    "token_multiset_f1": f"""WITH {TURNS}, e AS (SELECT conv_id, turn, k, count(*) AS e FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(expected), '{_TOKEN}')) AS k FROM turns) GROUP BY ALL),
p AS (SELECT conv_id, turn, k, count(*) AS p FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(predicted), '{_TOKEN}')) AS k FROM turns) GROUP BY ALL),
b AS (SELECT conv_id, turn, k, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM e FULL JOIN p USING (conv_id, turn, k)),
s AS (SELECT conv_id, turn, sum(least(e, p)) AS m, sum(greatest(e, p)) AS u, sum(e) AS ne, sum(p) AS np FROM b GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(m / nullif(np, 0), 0), 6) AS precision, round(coalesce(m / nullif(ne, 0), 0), 6) AS recall, round(coalesce(2 * m / nullif(ne + np, 0), 0), 6) AS f1, round(coalesce(m / nullif(u, 0), 0), 6) AS jaccard FROM s""",
    "token_counts": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_TOKEN}') AS t FROM documents)",
    "ned": f"WITH {TURNS}, l AS (SELECT role, lower(expected) AS expected, lower(predicted) AS predicted FROM turns) SELECT role, round(avg({_CER}), 6) AS ned FROM l GROUP BY role",
    "qa_accuracy": f"WITH {TURNS} SELECT role, round(avg((lower(expected) = lower(replace(predicted, 'ht', 'th')))::INT), 6) AS accuracy FROM turns GROUP BY role",
    "conversation_prompt_pairs": "SELECT conv_id, turn, text AS prompt, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'",
    "latex_fixups": r"SELECT item_id, t || repeat('}', greatest(0, (length(t) - length(replace(t, '{', ''))) - (length(t) - length(replace(t, '}', ''))))) AS latex FROM (SELECT item_id, replace(replace(text, 'e', '{e'), '\\', '\') AS t FROM benchmark)",
}
