"""Choosing rows: allowed lists, rankings, explicit ids, completeness, what is still to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(df: DataFrame, lists: dict[str, list[str] | None]) -> DataFrame:
    """Rows whose columns are in their lists, whatever their case; a column without a list admits all. No list may be empty."""
    for column, names in lists.items():
        if names is not None:
            if not names:
                raise ValueError(f"no value of {column} is allowed")
            df = df.where(F.lower(column).isin([n.lower() for n in names]))
    return df


def resolved(df: DataFrame, boxes: str, question: str) -> DataFrame:
    """Tasks whose answer has a box and whose question has no placeholder in braces left."""
    return df.where((F.size(boxes) > 0) & ~F.col(question).rlike(r"\{[a-z_0-9]+\}"))


def annotated(*columns: str) -> Column:
    """Whether a list has an entry or a text more than blanks; strings and arrays by what the column is named with (array columns end in [])."""
    tests = [F.coalesce(F.size(c[:-2]) > 0, F.lit(False)) if c.endswith("[]") else F.coalesce(F.trim(c) != "", F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def long_enough(df: DataFrame, column: str, least: int) -> DataFrame:
    """Texts of at least so many characters after cleaning."""
    return df.where(F.length(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))) >= least)


def first_valid(ranking: DataFrame, files: DataFrame, key: str, order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` ranked rows that have a file, in order; an error where there are fewer."""
    out = ranking.join(files.select(key).distinct(), key, "left_semi").orderBy(*order).limit(n)
    have = out.count()
    if have < n:
        raise ValueError(f"only {have} of {n} ranked rows have a file")
    return out


def chosen(df: DataFrame, key: str, ids: list | None = None, first: int | None = None, start: int = 0) -> DataFrame:
    """The rows with explicit ids, or ``first`` rows by key from ``start`` on."""
    if ids is not None:
        return df.where(F.col(key).isin(ids))
    out = df.orderBy(key).offset(start)
    return out if first is None else out.limit(first)


def crossed(entries: DataFrame, catalog: DataFrame, n_questions: str = "n_questions") -> DataFrame:
    """Each entry with each task of the catalogue and each of its questions' numbers: the catalogue is a few rows, exploded in place."""
    rows = [r.asDict() for r in catalog.collect()]  # a catalogue of tasks, tens of rows
    kinds = [f for f in catalog.schema.fields if f.name != n_questions]
    each = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kinds), F.lit(i).alias("question_idx")) for r in rows for i in range(r[n_questions])))
    return entries.withColumn("_task", F.explode(each)).select(*entries.columns, "_task.*")


def file_state(files: DataFrame, key: str, kind: str, needs: tuple[str, str] = ("pdf", "json"), temporary: str = r"_[0-9]{6,}$") -> DataFrame:
    """(key, complete, orphan, temporary) of each key: whether it has both kinds, the first without the second, or a name with a process id."""
    has = lambda k: F.bool_or(F.col(kind) == k)
    out = files.groupBy(key).agg(has(needs[0]).alias("a"), has(needs[1]).alias("b"))
    return out.select(key, (F.col("a") & F.col("b")).alias("complete"), (F.col("a") & ~F.col("b")).alias("orphan"), F.col(key).rlike(temporary).alias("temporary"))


def integrity(state: DataFrame) -> DataFrame:
    """Counts of :func:`file_state` and the class of the mismatch."""
    n = [F.count_if(c).alias(c) for c in ("complete", "orphan", "temporary")]
    kind = F.when((F.col("orphan") == 0) & (F.col("temporary") == 0), "ok").when(F.col("orphan") <= F.col("complete") * 0.01, "minor").otherwise("major")
    return state.agg(*n).withColumn("mismatch", kind)


def write_missing(df: DataFrame, have: list[str], metrics: dict[str, Column], overwrite: bool = False) -> DataFrame:
    """``df`` with the metrics that ``have`` doesn't name already, or all with ``overwrite``."""
    return df.select("*", *(c.alias(n) for n, c in metrics.items() if n not in have)) if not overwrite else df.drop(*metrics).select("*", *(c.alias(n) for n, c in metrics.items()))


def split_groups(df: DataFrame, keys: list[str], group: str, part: str, order: str, boxes: tuple[str, str, str, str]) -> DataFrame:
    """Groups cut by ``part`` (a line's words by their paragraph), bounds anew, numbered by where each first appears."""
    x1, y1, x2, y2 = boxes
    g = df.groupBy(*keys, group, part).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min(x1).alias(x1), F.min(y1).alias(y1), F.max(x2).alias(x2), F.max(y2).alias(y2))
    return g.withColumn("new_group", F.row_number().over(Window.partitionBy(*keys).orderBy(group, "first")) - 1)


def rolling_shards(df: DataFrame, worker: str, order: str, size: int) -> DataFrame:
    """shard and pos of each row: workers fill shards of ``size`` rows one after another, each from its own first shard."""
    n = F.row_number().over(Window.partitionBy(worker).orderBy(order)) - 1
    return df.withColumn("shard", F.floor(n / size).cast("long")).withColumn("pos", (n % size).cast("long"))


def shard_entries(df: DataFrame, worker: str, order: str) -> DataFrame:
    """The manifest of :func:`rolling_shards`: how many rows a shard has, its first and its last."""
    return df.groupBy(worker, "shard").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def log_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, state) of log lines that say what became of a file: processed, failed or empty (no page). A path's last word counts: failed
    over empty over processed."""
    c = F.col(column)
    state = F.when(c.rlike(r"(?i)\b(error|failed|exception)\b"), 2).when(c.rlike(r"(?i)\b(0 pages|zero pages|no pages)\b"), 1).when(c.rlike(r"(?i)\b(processed|completed|success\w*)\b"), 0)
    path = F.regexp_extract(c, r"([^\s:'\"]+\.pdf)\b", 1)
    found = lines.select(path.alias("path"), state.alias("s")).where("path <> '' and s is not null")
    return found.groupBy("path").agg(F.element_at(F.array(F.lit("processed"), F.lit("empty"), F.lit("failed")), F.max("s") + 1).alias("state"))


def prediction_score(variant: Column) -> Column:
    """A prediction's score: score, else confidence, else prob, as a number; null where none is one."""
    return F.coalesce(*(F.try_variant_get(variant, f"$.{k}", "double") for k in ("score", "confidence", "prob")))


def literal_list(c: Column, schema: str) -> Column:
    """A list written as Python writes it (single quotes, None, True), parsed as data and never evaluated."""
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(json, schema, {"allowSingleQuotes": "true"})


def fallback_text(text: Column, lines: Column) -> Column:
    """The text, or where it is blank the lines joined by blanks."""
    return F.coalesce(F.when(F.trim(text) != "", text), F.array_join(lines, " "))


def label(lines: Column) -> Column:
    """Lines as one label: joined, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))


def output_name(folder: Column, prefix: str = "idl-") -> Column:
    """A source folder's output name, without the prefix it begins with."""
    return F.regexp_replace(folder, f"^{prefix}", "")
