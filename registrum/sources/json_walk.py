"""Words out of the JSON of text recognition services, nested to any depth.

The document is parsed once to VARIANT. A frontier of nodes goes down level by level: of a node the first container that
is not empty (``CONTAINERS``) is entered, a list is taken apart with each item's place, and a node without containers is
a word if it has a text. ``LEVELS`` levels are entered inside of a row, then the nodes are dealt to rows; the walk ends when none
is left to enter, so its rounds are the levels of the deepest document by ``LEVELS``, and all documents go down together. A word's place is the path of list positions that led to it, which is the
order of a walk depth first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import kept

#: Keys of a response that hold other nodes, a node's text, its certainty and its box, in the order they are looked at.
CONTAINERS = ("regions", "tokens", "words", "lines")
TEXTS, CONFIDENCES, BOXES, POINTS = ("source", "text", "target"), ("confidence", "conf"), ("boundingBox", "bbox"), ("vertices", "points")
#: Certainty of a word without one.
UNSURE = 0.9
#: How many levels are entered inside of a row before what is left is kept and looked at.
LEVELS = 6


MEMBERS, ITEMS = "map<string,variant>", "array<variant>"


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _filled(value: Column) -> Column:
    """Whether a JSON value is neither missing nor null, empty, zero or false."""
    items = F.size(_as(value, ITEMS))
    return F.when(value.isNull(), False).when(items >= 0, items > 0).otherwise(~F.to_json(value).isin("null", "{}", '""', "0", "0.0", "-0.0", "false"))


def _first(members: str, names: tuple[str, ...]) -> Column:
    """The first filled one of an object's members, else null."""
    return F.coalesce(*[X.let(F.try_element_at(F.col(members), F.lit(k)), lambda v: F.when(_filled(v), v)) for k in names])


def _number(value: Column) -> Column:
    """A number, or text that is one; else null."""
    return _as(value, "double")


def _root(body: str) -> Column:
    """Where the walk starts: the output of the first pipeline answer, else what the response calls output or answer, else all of it."""

    def start(whole: Column) -> Column:
        get = lambda path: F.try_variant_get(whole, path, "variant")
        filled = lambda path: X.let(get(path), lambda v: F.when(_filled(v), v))
        return F.coalesce(get("$.pipelineResponse[0].output"), filled("$.output"), filled("$.pipelineResponse"), whole)

    return X.let(F.try_parse_json(F.col(body)), start)


def _point(p: Column) -> Column:
    """x and y of a point, a list of two or an object in which a missing one is 0; null for anything else."""
    of_list = lambda xs: F.when(F.size(xs) >= 2, F.struct(_number(F.get(xs, F.lit(0))).alias("x"), _number(F.get(xs, F.lit(1))).alias("y")))
    of_object = lambda m: F.when(m.isNotNull(), F.struct(*[F.coalesce(_number(F.try_element_at(m, F.lit(c))), F.lit(0.0)).alias(c) for c in "xy"]))
    return F.coalesce(X.let(_as(p, ITEMS), of_list), X.let(_as(p, MEMBERS), of_object))


def _boxed(words: DataFrame, scale: float) -> DataFrame:
    """Adds x, y, w, h in pixels of the page: around the points if there are any, else from a corner and a size or a second corner.
    Each step is a column of its own, as the later ones read it several times."""
    rows = words.withColumn("raw", _first("m", BOXES)).withColumn("b", _as(F.col("raw"), MEMBERS))
    rows = rows.withColumn("points", F.coalesce(_as(F.col("raw"), ITEMS), _as(_first("b", POINTS), ITEMS)))
    rows = rows.withColumn("pairs", F.filter(F.transform("points", _point), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    names = ("x1", "x", "y1", "y", "x2", "y2", "w", "width", "h", "height")
    rows = rows.withColumn("n", F.struct(*[_number(F.try_element_at("b", F.lit(k))).alias(k) for k in names]))
    of = lambda *keys: F.coalesce(*[F.col(f"n.{k}") for k in keys])
    x1, y1 = F.coalesce(of("x1", "x"), F.lit(0.0)), F.coalesce(of("y1", "y"), F.lit(0.0))
    far = lambda name, near: F.coalesce(F.nullif(of(name), F.lit(0.0)), near) - near
    sized = (x1, y1, F.coalesce(of("w", "width"), far("x2", x1)), F.coalesce(of("h", "height"), far("y2", y1)))
    x, y = F.col("pairs.x"), F.col("pairs.y")
    around = (F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))
    plain = (F.col("b").isNotNull()) & (F.coalesce(F.size("points"), F.lit(0)) <= 0)
    return rows.withColumns({c: F.coalesce((F.when(F.size("pairs") > 0, p).when(plain, q) / scale).cast("long"), F.lit(0).cast("long")) for c, p, q in zip("xywh", around, sized, strict=True)})


def words_of_json(responses: DataFrame, id_column: str = "doc_id", body: str = "body", scale: float = 1.0) -> DataFrame:
    """A row for each word of the responses: id, path (array of list positions, in reading order), text, confidence (0 to 1), x, y,
    w, h. scale is how much larger the picture was that the service saw. A body that is null or no JSON gives no word; a word's
    certainty above 1 counts as percent, one that is no number as 0.9. Repeated rows give their words each time."""
    nodes = responses.select(F.col(id_column), F.array().cast("array<int>").alias("path"), _root(body).alias("node"))
    found = None
    while True:
        rows = nodes.select(id_column, F.explode(_below(F.array(F.struct("path", "node", F.lit(False).alias("done"))), LEVELS)).alias("p")).select(id_column, "p.*")
        level = kept(rows.select(id_column, "path", "node", (~F.col("done") & _inner(F.col("node")).isNotNull()).alias("enters")))
        words = _words(level.where("NOT enters").withColumn("m", _as(F.col("node"), MEMBERS)).where("m IS NOT NULL"), id_column, scale)
        found = words if found is None else found.unionByName(words)
        nodes = level.where("enters").select(id_column, "path", "node")
        if nodes.isEmpty():
            return found


def _inner(node: Column) -> Column:
    """What is entered of a node: a list itself, an object's first filled container; null for a word or a plain value."""
    names = [X.let(F.try_variant_get(node, f"$.{k}", "variant"), lambda v: F.when(_filled(v), v)) for k in CONTAINERS]
    return F.when(_as(node, ITEMS).isNotNull(), node).otherwise(F.coalesce(*names))


def _below(nodes: Column, levels: int) -> Column:
    """An array of nodes, each that can be entered replaced by what it holds, so many times. done: looked at, and nothing to enter."""

    def enter(n: Column) -> Column:
        def parts(inner: Column) -> Column:
            taken = lambda items: F.when(items.isNull(), F.array(F.struct(n["path"].alias("path"), inner.alias("node"), F.lit(False).alias("done")))).otherwise(F.transform(items, lambda x, i: F.struct(F.array_append(n["path"], i).alias("path"), x.alias("node"), F.lit(False).alias("done"))))
            return F.when(inner.isNull(), F.array(F.struct(n["path"].alias("path"), n["node"].alias("node"), F.lit(True).alias("done")))).otherwise(X.let(_as(inner, ITEMS), taken))

        return F.when(n["done"], F.array(n)).otherwise(X.let(_inner(n["node"]), parts))

    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, enter))
    return nodes


def _words(nodes: DataFrame, id_column: str, scale: float) -> DataFrame:
    rows = nodes.withColumn("t", _first("m", TEXTS))
    rows = rows.withColumn("text", F.regexp_replace(F.coalesce(_as(F.col("t"), "string"), F.to_json("t")), r"(?U)^\s+|\s+$", "")).where("text <> ''")
    given = F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in CONFIDENCES])
    rows = rows.withColumn("sure", F.coalesce(_number(given), F.lit(UNSURE)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("sure") > 1, F.col("sure") / 100).otherwise(F.col("sure"))))
    return _boxed(rows.withColumn("confidence", sure), scale).select(id_column, "path", "text", "confidence", "x", "y", "w", "h")


def text_of_json(words: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, text (a word a line, in reading order), confidence (their mean), n_words of each response with words."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda w: w["text"])
    return words.groupBy(id_column).agg(F.array_join(ordered, "\n").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"))
