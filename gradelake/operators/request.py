"""Grading requests as rows: keyword reading, validation of model JSON, merging of flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.replies import salvaged_object
from gradelake.functions.text import strip
from gradelake.session import staged
from gradelake.sources import store

# Defaults, limits and the words that name a task or a switch.
DEFAULT_DPI = 400
FAST_DPI = 300
LAST_STEP = 18
FIRST_N = r"first\s+(\d+)"
MODES = ("all", "specific", "first_n")
FAST_WORDS = ("fast", "quick")
RESCAFFOLD_WORDS = ("rescaffold", "reparse", "rebuild scaffold")
NO_REPORT_WORDS = ("no report", "terminal only")
CLEAN_OBJECTS = ("clean", "deskew", "scan")
SWITCHES = ("skip_clean_scan", "force_clean_scan", "rescaffold", "no_report")


def _any(text: Column, words) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def keyword_request(df: DataFrame, prompt: str = "prompt", dpi: Column | None = None) -> DataFrame:
    """Task, student filter, resolution and switches read from the words of a request."""
    p = F.lower(F.col(prompt))
    task = (F.when(p.contains("count") & p.contains("mark"), "count_marks")
            .when(_any(p, ("multiple choice", " mc ", "check mc")), "check_mc").otherwise("check_answers"))
    n = F.coalesce(F.nullif(F.regexp_extract(p, FIRST_N, 1), F.lit("")).try_cast("int"), F.lit(0))
    skip = p.contains("skip") & _any(p, CLEAN_OBJECTS)
    force = ((p.contains("force") & p.contains("clean")) | p.contains("re-clean")
             | F.replace(p, F.lit(" "), F.lit("")).contains("reclean"))
    both = skip & force
    chosen = F.when(_any(p, FAST_WORDS), FAST_DPI).otherwise(DEFAULT_DPI)
    return df.withColumns({
        "task_type": task,
        "mode": F.when(n > 0, "first_n").otherwise("all"),
        "names": F.expr("cast(array() as array<string>)"),
        "n": n,
        "dpi": chosen if dpi is None else F.coalesce(F.nullif(dpi, F.lit(0)), chosen),
        "skip_clean_scan": skip & ~both,
        "force_clean_scan": force & ~both,
        "rescaffold": _any(p, RESCAFFOLD_WORDS),
        "no_report": _any(p, NO_REPORT_WORDS),
        "through_step": F.lit(None).cast("int"),
    })


def _text(doc: Column, path: str) -> Column:
    """Scalar at a path as text; JSON null and absence are NULL."""
    return F.try_variant_get(doc, path, "string")


def _is_text(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING"


def _whole(doc: Column, path: str) -> Column:
    """Integer value: a number loses its fraction, a text has to be a whole number."""
    text = _text(doc, path)
    shape = F.when(_is_text(doc, path), text.rlike(r"(?U)^\s*[+-]?\d+\s*\z")).otherwise(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    return F.when(shape, strip(text).try_cast("double").try_cast("int"))


def _truthy(doc: Column, path: str) -> Column:
    """Any text but the empty one, any number but 0, true, and lists and objects with content."""
    text = F.lower(F.coalesce(_text(doc, path), F.try_variant_get(doc, path, "variant").cast("string"), F.lit("")))
    number = F.coalesce(text.try_cast("double"), F.lit(1.0))
    return F.when(F.coalesce(_is_text(doc, path), F.lit(False)), text != "").otherwise(~text.isin("", "false", "null", "[]", "{}") & (number != 0))


def validated_request(df: DataFrame, raw: str = "raw", dpi: Column | None = None) -> DataFrame:
    """Model JSON coerced field by field; rows without a usable object keep their keyword reading.

    ``df`` carries the columns of :func:`keyword_request`.
    """
    doc = F.try_parse_json(F.nullif(salvaged_object(F.col(raw)), F.lit("{}")))
    df = df.withColumn("_d", doc)
    d = F.col("_d")
    flt = lambda k: _text(d, f"$.student_filter.{k}")
    mode = F.regexp_replace(F.lower(strip(F.coalesce(F.nullif(flt("mode"), F.lit("")), F.lit("all")))), "[- ]", "_")
    names = F.filter(F.coalesce(F.try_variant_get(d, "$.student_filter.names", "array<string>"), F.expr("cast(array() as array<string>)")),
                     lambda x: x.isNotNull())
    df = df.withColumns({"_mode": mode, "_names": names, "_n": F.coalesce(_whole(d, "$.student_filter.n"), F.lit(0))})
    ok_mode = (F.when((F.col("_mode") == "specific") & (F.size("_names") > 0), "specific")
               .when((F.col("_mode") == "first_n") & (F.col("_n") > 0), "first_n").otherwise("all"))
    step = _whole(d, "$.through_step")
    on = {s: _truthy(d, f"$.{s}") for s in SWITCHES}
    both = on["skip_clean_scan"] & on["force_clean_scan"]
    read_dpi = F.coalesce(_whole(d, "$.dpi"), F.lit(DEFAULT_DPI))
    model = {
        "task_type": F.coalesce(_text(d, "$.task_type"), F.col("task_type")),
        "mode": ok_mode,
        "names": F.when(ok_mode == "specific", F.col("_names")).otherwise(F.expr("cast(array() as array<string>)")),
        "n": F.when(ok_mode == "first_n", F.col("_n")).otherwise(0),
        "dpi": read_dpi if dpi is None else F.coalesce(F.nullif(dpi, F.lit(0)), read_dpi),
        "skip_clean_scan": on["skip_clean_scan"] & ~both,
        "force_clean_scan": on["force_clean_scan"] & ~both,
        "rescaffold": on["rescaffold"],
        "no_report": on["no_report"],
        "through_step": F.when(step.between(1, LAST_STEP), step),
    }
    usable = d.isNotNull()
    out = df.withColumns({c: F.when(usable, v).otherwise(F.col(c)) for c, v in model.items()})
    for c in ("folder_hint", "folder_path"):
        out = out.withColumn(c, strip(F.nullif(_text(d, f"$.{c}"), F.lit(""))))
    return out.drop("_d", "_mode", "_names", "_n")


def merged_flags(df: DataFrame, cli: str = "cli_") -> tuple[DataFrame, DataFrame]:
    """Switches of the command line or the request; ``(accepted, rejected)`` rows.

    A row that both skips and forces the cleaning is rejected. The command line's step wins.
    """
    either = {s: F.col(cli + s) | F.col(s) for s in SWITCHES}
    merged = df.withColumns({**either, "through_step": F.coalesce(cli + "through_step", "through_step")})
    merged = merged.drop(*[cli + s for s in SWITCHES], cli + "through_step")
    clash = F.col("skip_clean_scan") & F.col("force_clean_scan")
    return merged.filter(~clash), merged.filter(clash)


def fresh_caches(sources: DataFrame, caches: DataFrame, key: str) -> DataFrame:
    """Keys whose derived file exists and is not older than any of their sources."""
    newest = sources.groupBy(key).agg(F.max("mtime").alias("newest"))
    return newest.join(caches.select(key, F.col("mtime").alias("cached")), key).withColumn(
        "fresh", F.col("newest") <= F.col("cached"))


def refreshed(sources: DataFrame, folder: str, key: str, build: Callable[[DataFrame], DataFrame], version: int) -> DataFrame:
    """Builds the stored rows of stale keys anew and returns the table with ``rebuilt``.

    ``sources`` carry ``key, mtime``; stored rows carry the ``mtime`` of what they were built of. A key is stale without a stored row,
    or with a newer source. ``build`` sees the sources of stale keys only, and only their ranges of the table are written.
    """
    spark = sources.sparkSession
    newest = sources.groupBy(key).agg(F.max("mtime").alias("newest"))
    if store.stored_version(spark, folder) == version:
        stored = store.load(spark, folder, version).select(key, F.col("mtime").alias("cached"))
        stale = newest.join(stored, key, "left").filter(F.col("cached").isNull() | (F.col("newest") > F.col("cached"))).select(key)
    else:
        stale = newest.select(key)
    stale = staged(stale, "stale")
    store.replace(build(sources.join(stale, key, "left_semi")), folder, [key], version)
    return store.load(spark, folder, version).join(stale.withColumn("rebuilt", F.lit(True)), key, "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(False)))
