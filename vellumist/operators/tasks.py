"""Task templates and the questions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import uniform

CATALOG = [
    ("reading", "[image]", "[text]", "Read all text of {image}."),
    ("reading", "[image]", "[lines, box]", "Read the lines of {image} with their boxes."),
    ("reading", "[image]", "[text2d]", "Read {image} with its layout."),
    ("detection", "[lines, image]", "[box]", "Where are the lines of {image}?"),
    ("conditional_detection", "[words, image]", "[box]", "Where is {text} in {image}?"),
    ("localized_reading", "[image]", "[lines]", "What stands at {box} in {image}?"),
    ("reading", "[image]", "[paragraphs, box]", "Read the paragraphs of {image}."),
    ("reading", "[image]", "[latex]", "Give the formulas of {image}."),
]
ALWAYS = "image"


def type_list(c: Column) -> Column:
    """'[a, b]' as an array, and a bare word as an array of it."""
    return F.transform(F.split(F.regexp_replace(c, r"[\[\]]", ""), ","), lambda x: F.trim(x))


def catalog(spark) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "template int, task string, input_type string, output_type string, question string")


def needs(task: DataFrame) -> DataFrame:
    """The catalog with ``required``: input and output types that a page must have, boxes and images aside."""
    both = F.array_distinct(F.concat(type_list(F.col("input_type")), type_list(F.col("output_type"))))
    return task.withColumn("required", F.array_except(both, F.array(F.lit(ALWAYS), F.lit("box"))))


def compatible(pages: DataFrame, tasks: DataFrame, available: str = "available") -> DataFrame:
    """Pages with each template whose types they have; the catalog is a fixed small table."""
    return pages.join(F.broadcast(needs(tasks)), F.size(F.array_except("required", F.col(available))) == 0)


def picked(pairs: DataFrame, page: str, seed: str = "42") -> DataFrame:
    """One template a page: the task category by one draw, then the template within it by another, from the page's key alone."""
    by_task = pairs.groupBy(page, "task").agg(F.array_sort(F.collect_list(F.struct("template", "question"))).alias("ts"))
    groups = by_task.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("task", "ts"))).alias("gs"))
    draw = lambda n, salt: F.floor(uniform(F.col(page), seed + salt) * n).cast("int")
    g = F.get("gs", draw(F.size("gs"), "task"))
    chosen = groups.withColumn("g", g)
    t = F.get("g.ts", draw(F.size("g.ts"), "template"))
    return chosen.select(page, F.col("g.task").alias("task"), t["template"].alias("template"), t["question"].alias("question"))


def eligible(items: Column, least: int = 4) -> Column:
    """Items whose text has ``least`` characters, or all where none has."""
    long_ = F.filter(items, lambda x: F.length(x["text"]) >= least)
    return F.when(F.size(long_) > 0, long_).otherwise(items)


def fill(question: Column, image: Column, text: Column, box: Column) -> Column:
    for name, value in (("{image}", image), ("{text}", text), ("{box}", box)):
        question = F.replace(question, F.lit(name), F.coalesce(value, F.lit("")))
    return question


def same_text(words: DataFrame, chosen: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, text, boxes): the boxes of all words of a page that equal the chosen text without case and blanks, in reading order."""
    key = F.lower(F.trim("text"))
    asked = chosen.groupBy(page).agg(F.collect_set(key).alias("_asked"))  # a row a page, so that words are joined where they lie by page
    hits = words.select(page, key.alias("k"), "x1", "y1", "x2", "y2").join(asked, page).where(F.array_contains("_asked", F.col("k"))).drop("_asked")
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "x2", "y2"))), lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]))
    return hits.groupBy(page, "k").agg(boxes.alias("boxes"))


def next_turn(turns: DataFrame, by: str, order: str) -> DataFrame:
    """Each prompt with the answer that follows it."""
    w = Window.partitionBy(by).orderBy(order)
    rows = turns.withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select(by, order, F.col("text").alias("prompt"), "answer")


#: Shares of page width and height that boxes of a level take: least and most width, least and most height.
EXTENTS = {"words": (0.02, 0.10, 0.01, 0.03), "lines": (0.20, 0.80, 0.01, 0.03), "paragraphs": (0.30, 0.90, 0.05, 0.20)}


def fake_boxes(page: Column, width: Column, height: Column, level: str = "lines", n: int = 3, seed: str = "42") -> Column:
    """``n`` boxes inside a page that has none of its own, drawn from its key alone."""
    w0, w1, h0, h1 = EXTENTS[level]

    def one(i: Column) -> Column:
        u = [uniform(F.concat_ws("/", page.cast("string"), i.cast("string"), F.lit(k)), seed) for k in "abcd"]
        w, h = (width * (w0 + (w1 - w0) * u[0])).cast("int"), (height * (h0 + (h1 - h0) * u[1])).cast("int")
        x, y = ((width - w) * u[2]).cast("int"), ((height - h) * u[3]).cast("int")
        return F.array(x, y, x + F.greatest(w, F.lit(1)), y + F.greatest(h, F.lit(1)))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), one)


def answer(output_type: Column, task: Column, levels: dict[str, Column], text: Column, text2d: Column, chosen: Column) -> Column:
    """The expected answer: text, layout text, boxes or items of a level as JSON, or the chosen item's own; null where a level is missing.

    ``levels`` hold items (text, box) of lines, words, paragraphs and latex; ``chosen`` is the item or the items that a localized or
    conditional question is about.
    """
    about = task.isin("conditional_detection", "localized_reading")
    order = lambda c: F.array_sort(F.transform(c, lambda i: F.struct(F.get(i["box"], F.lit(1)).alias("y"), F.get(i["box"], F.lit(0)).alias("x"), i["text"].alias("text"), i["box"].alias("box"))))
    out = F.when(about & output_type.contains("box"), F.to_json(F.transform(order(chosen), lambda i: i["box"])))
    out = out.when(about, F.array_join(F.transform(order(chosen), lambda i: i["text"]), " "))
    out = out.when(output_type.contains("text2d"), text2d).when(output_type.contains("text"), text)
    for name, items in levels.items():
        full = F.to_json(F.transform(order(items), lambda i: F.struct(i["text"].alias("text"), i["box"].alias("bbox"))))
        out = out.when(output_type.contains(name) & output_type.contains("box"), full)
        out = out.when(output_type.contains(name), F.to_json(F.transform(order(items), lambda i: i["text"])))
    return out.when(output_type.contains("box"), F.to_json(F.transform(order(levels["lines"]), lambda i: i["box"])))


def empty_prompts(pages: DataFrame, tasks: DataFrame, page: str, seed: str = "42") -> DataFrame:
    """(page, task, template, question, answer) for pages without text: a template by a draw from the key, and its empty answer.

    Templates about one item are left out, as an empty page has none.
    """
    usable = tasks.where(~F.col("task").isin("conditional_detection", "localized_reading"))
    p = picked(pages.select(page).join(F.broadcast(usable)), page, seed)
    kinds = F.broadcast(usable.select("template", "output_type"))
    return p.join(kinds, "template").select(page, "task", "template", "question", F.when(F.col("output_type").contains("box"), "[]").otherwise("").alias("answer"))
