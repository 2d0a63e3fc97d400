"""Sinks: CSV, partitions by key, appended JSON lines, report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions of ``key`` that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def lines(df: DataFrame, line: Column, order: list[str], path: str) -> None:
    """A text file of report lines in order. Reports are small: they are sorted into one part."""
    df.select(line.alias("value"), *order).orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path)


def csv_field(c: Column) -> Column:
    """A client-side CSV field: null empty; quoted, quotes doubled, where it has a comma, quote or line break."""
    text = c.cast("string")
    return F.when(c.isNull(), "").when(text.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def survey(questions: DataFrame, order: list[str], title: str) -> DataFrame:
    """One row ``html``: a page that holds the questions as JSON, with what would end the script escaped. A survey is small."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*questions.columns).alias("q"))))
    text = F.replace(F.to_json(F.transform(rows, lambda x: x["q"])), F.lit("</"), F.lit("<\\/"))
    head = f'<!doctype html><meta charset="utf-8"><title>{title}</title><script type="application/json" id="data">'
    return questions.agg(F.concat(F.lit(head), text, F.lit("</script>")).alias("html"))


def svg(pixels: DataFrame, colours: dict[int, str], mm: float) -> DataFrame:
    """(``img``, ``svg``): a picture's labels as one path for each colour, in the order of ``colours``, a run of pixels in a row a box; ``mm`` to a pixel."""
    run = pixels.where(F.col("label").isin(*colours)).withColumn("_k", F.col("x") - F.row_number().over(Window.partitionBy("img", "y", "label").orderBy("x")))
    run = run.groupBy("img", "label", "y", "_k").agg(F.min("x").alias("x"), F.count("*").alias("n"))
    box = F.format_string("M%d %dh%dv1h-%dz", "x", "y", "n", "n")
    path = run.groupBy("img", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", box.alias("d")))), lambda b: b["d"]), "").alias("d"))
    names = F.create_map(*[F.lit(v) for pair in colours.items() for v in pair])
    place = F.create_map(*[F.lit(v) for i, k in enumerate(colours) for v in (k, i)])
    layer = F.struct(place[F.col("label")].alias("i"), F.concat(F.lit('<path fill="'), names[F.col("label")], F.lit('" d="'), "d", F.lit('"/>')).alias("p"))
    layers = path.groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(layer)), lambda b: b["p"]), "").alias("p"))
    size = pixels.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.2fmm" height="%.2fmm" viewBox="0 0 %d %d">', F.col("w") * mm, F.col("h") * mm, F.col("w"), F.col("h"))
    return size.join(layers, "img", "left").select("img", F.concat(head, F.coalesce("p", F.lit("")), F.lit("</svg>")).alias("svg"))


def maps(pixels: DataFrame) -> DataFrame:
    """(``img``, ``height``, ``width``, ``labels``): each label map as one array in reading order, to spill beside its picture."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "label")))
    made = pixels.groupBy("img").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), rows.alias("_r"))
    return made.select("img", "height", "width", F.transform("_r", lambda p: p["label"].cast("int")).alias("labels"))


def document(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
