"""Question trees as adjacency tables ``exam_id, path, number, …``.

``path`` is the array of positions from the top-level question down; arrays compare element by
element, so ordering by ``path`` is the order of a depth-first walk. Printed papers nest three
levels (number, letter, roman numeral); a node has at most 26 letters and 20 numerals below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.functions.text import strip
from gradelake.operators.ordered import block_of, rank_in_order
from gradelake.session import staged

# Limits, version and wording of the stored tree.
SCHEMA_VERSION = 15
LISTED_LEAVES = 24
DEFAULT_TYPE = "short_answer"
MC = "multiple_choice"


def _parent(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(path) - 1)


def _root(nodes: DataFrame) -> Column:
    """The top-level question: the column ``root`` where nodes carry it, by which they may lie together already."""
    return F.col("root") if "root" in nodes.columns else F.get("path", F.lit(0))


def with_leaf_flag(nodes: DataFrame) -> DataFrame:
    """``is_leaf``: no other node names this one as its parent."""
    parents = (nodes.filter(F.size("path") > 1).select("exam_id", _parent(F.col("path")).alias("path")).distinct()
               .withColumn("_p", F.lit(True)))
    return nodes.join(parents, ["exam_id", "path"], "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p")


def ancestors_of(nodes: DataFrame) -> DataFrame:
    """One row per node and ancestor: the node's columns with ``path`` of the ancestor."""
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    return nodes.filter(F.size("path") > 1).withColumn("path", F.explode(above))


def rolled_up_marks(nodes: DataFrame) -> DataFrame:
    """Marks of inner nodes are the sum of their leaves; a printed total wins at the top.

    ``nodes`` carry ``is_leaf``, ``marks`` and either ``total`` or the ``text`` to read it from.
    """
    sums = (ancestors_of(nodes.filter("is_leaf").select("exam_id", "path", "marks")).groupBy("exam_id", "path")
            .agg(F.sum("marks").alias("_s")))
    printed = F.col("total") if "total" in nodes.columns else T.total_footer(F.col("text"))
    total = F.when(F.size("path") == 1, printed)
    return (nodes.join(sums, ["exam_id", "path"], "left")
            .withColumn("marks", F.when(F.col("is_leaf"), F.col("marks")).otherwise(F.coalesce(total, "_s"))).drop("_s"))


def first_leaves(nodes: DataFrame, n: int = LISTED_LEAVES) -> DataFrame:
    """First ``n`` leaves of every exam; Spark limits each group before the shuffle."""
    order = Window.partitionBy("exam_id").orderBy("path")
    return nodes.filter("is_leaf").withColumn("leaf_no", F.row_number().over(order)).filter(F.col("leaf_no") <= n)


def exam_summary(nodes: DataFrame) -> DataFrame:
    """Total marks and description with the first leaves of every exam."""
    counts = nodes.groupBy("exam_id").agg(
        F.count_if(F.size("path") == 1).alias("roots"), F.count_if("is_leaf").alias("leaves"),
        F.sum(F.when(F.col("is_leaf"), F.col("marks"))).alias("total_marks"))
    listed = F.array_sort(F.collect_list(F.struct("leaf_no", F.format_string("Q%s(%dm)", "number", F.col("marks").cast("bigint")).alias("t"))))
    shown = first_leaves(nodes).groupBy("exam_id").agg(F.array_join(F.transform(listed, lambda s: s["t"]), ", ").alias("shown"))
    text = F.concat(F.col("roots").cast("string"), F.lit(" top-level, "), F.col("leaves").cast("string"), F.lit(" gradable parts, "),
                    F.col("total_marks").cast("string"), F.lit(" marks; "), "shown",
                    F.when(F.col("leaves") > LISTED_LEAVES, " …").otherwise(""))
    return counts.join(shown, "exam_id").select("exam_id", "roots", "leaves", "total_marks", text.alias("description"))


def clean_stems(nodes: DataFrame) -> DataFrame:
    """Mark cues out of the stems, plain glyphs and powers in stems and options."""
    return nodes.withColumns({
        "text": T.science_text(T.without_mark_cues(F.col("text"))),
        "answer_options": F.transform("answer_options", lambda o: F.struct(
            o["letter"].alias("letter"), T.science_text(o["text"]).alias("text"))),
    })


def with_parsed_options(nodes: DataFrame) -> DataFrame:
    """Multiple choice nodes without options get them from their text."""
    todo = (F.col("question_type") == MC) & (F.size("answer_options") == 0)
    df = nodes.withColumn("_t", F.when(todo, F.col("text")).otherwise(F.lit("")))
    df = T.with_options(df, "_t", "_stem", "_opts")
    found = F.size("_opts") > 0
    return df.withColumns({"text": F.when(found, F.col("_stem")).otherwise(F.col("text")),
                           "answer_options": F.when(found, F.col("_opts")).otherwise(F.col("answer_options"))}).drop("_t", "_stem", "_opts")


def without_mc_areas(nodes: DataFrame, columns: Sequence[str] = ("writing_areas", "equation_blanks")) -> DataFrame:
    """Multiple choice nodes have no writing areas and no blanks."""
    return nodes.withColumns({c: F.when(F.col("question_type") == MC, F.slice(F.col(c), F.lit(1), F.lit(0))).otherwise(F.col(c)) for c in columns})


def merge_answer_key(nodes: DataFrame, margin: DataFrame, table_rows: DataFrame, letters: DataFrame) -> DataFrame:
    """Three answer sources on the tree.

    ``margin``: ``exam_id, number, answer, criteria``; a single letter makes the question multiple
    choice. ``table_rows``: ``exam_id, number, body`` override and clear the criteria; parents that
    only their parts are listed for lose their own answer. ``letters``: ``exam_id, pos, letter`` go
    to the multiple choice leaves by position. Nodes may come without their text; then no options are read from it.
    """
    entry = F.struct(F.col("answer").alias("a"), F.col("criteria").alias("c"))
    beside = margin.select("exam_id", "number", entry.alias("_e"), F.lit(None).cast("string").alias("_b"))
    rows = table_rows.filter(strip(F.col("body")) != "").select("exam_id", "number", F.lit(None).cast(beside.schema["_e"].dataType).alias("_e"), strip(F.col("body")).alias("_b"))
    sources = beside.unionByName(rows).groupBy("exam_id", "number").agg(F.max("_e").alias("_e"), F.max("_b").alias("_b"))
    # Several branches read the tree with its sources, so the join is done once.
    df = staged(nodes.join(sources, ["exam_id", "number"], "left"), "sourced").withColumns({"_a": F.col("_e.a"), "_c": F.col("_e.c"), "_m": F.col("_e").isNotNull()}).drop("_e")
    answer = F.coalesce("_b", F.when(F.col("_m"), F.col("_a")).otherwise(F.col("correct_answer")))
    criteria = F.when(F.col("_m"), F.col("_c")).otherwise(F.col("marking_criteria"))
    # Only nodes with parts can lose an answer to these, and only multiple choice leaves take letters: each meets its own rows, the rest none.
    covered = ancestors_of(df.filter(F.col("_b").isNotNull()).select("exam_id", "path")).distinct().withColumn("_below", F.lit(True))
    may_lose = ~F.coalesce("is_leaf", F.lit(False)) & F.col("_b").isNull() & (answer.isNotNull() | criteria.isNotNull())
    df = df.withColumn("question_type", F.when(F.col("_a").rlike("^[A-Da-d]$"), MC).otherwise(F.col("question_type")))
    mc_leaf = F.col("is_leaf") & (F.col("question_type") == MC)
    ranked = rank_in_order(df.filter(mc_leaf).select("exam_id", "path").withColumn("_blk", block_of(F.get("path", F.lit(0)))), ["exam_id"], "_blk", [F.col("path")], "pos").drop("_blk")
    placed = ranked.join(letters.select("exam_id", "pos", F.col("letter").alias("_l")), ["exam_id", "pos"]).drop("pos")
    below, letter = F.lit(None).cast("boolean").alias("_below"), F.lit(None).cast("string").alias("_l")
    inner = df.filter(may_lose).join(covered, ["exam_id", "path"], "left").select(*df.columns, "_below", letter)
    chosen = df.filter(mc_leaf).join(placed, ["exam_id", "path"], "left").select(*df.columns, below, "_l")
    df = inner.unionByName(chosen).unionByName(df.filter(~may_lose & ~F.coalesce(mc_leaf, F.lit(False))).select(*df.columns, below, letter))
    lost = F.col("_below").isNotNull() & F.col("_b").isNull()
    df = df.withColumns({
        "correct_answer": F.coalesce("_l", F.when(~lost, answer)),
        "marking_criteria": F.when(~lost & F.col("_b").isNull(), criteria),
    }).drop("_a", "_c", "_m", "_b", "_below", "_l")
    return with_parsed_options(df) if "text" in df.columns else df


# ---- stored form -----------------------------------------------------------------------------

#: Stored levels. Printed papers nest three, a number, a letter and a numeral.
LEVELS = 6
BOX_TYPE = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
IMAGE_TYPE = f"struct<bbox:{BOX_TYPE},path:string>"
#: Lists of a node beside its options and parts, by their stored names.
LISTS = {
    "equation_blank_bboxes": f"array<{BOX_TYPE}>", "images": f"array<{IMAGE_TYPE}>", "writing_areas": f"array<struct<bbox:{BOX_TYPE},kind:string>>",
    "answer_images": f"array<{IMAGE_TYPE}>",
}
#: Other stored fields that are read, the older names of a text and an answer among them.
STORED = {
    **dict.fromkeys(("number", "question_type", "text", "content_summary", "correct_answer", "answer_key_text", "marking_criteria"), "string"),
    "marks": "bigint", "bbox": BOX_TYPE, "answer_options": "array<struct<letter:string,text:string>>",
}


def with_lists(nodes: DataFrame) -> DataFrame:
    """The four lists of a node; those that are absent or NULL are empty."""
    none = {c: F.expr(f"cast(array() as {t})") for c, t in LISTS.items()}
    return nodes.withColumns({c: F.coalesce(F.col(c), e) if c in nodes.columns else e for c, e in none.items()})


def _rounded(box: Column) -> Column:
    return F.struct(*[F.bround(box[c], 1).alias(c) for c in ("x0", "y0", "x1", "y1")], box["page"].alias("page"))


def _stored_list(name: str) -> Column:
    """A list with rounded boxes, NULL when it is empty."""
    other = {"images": "path", "answer_images": "path", "writing_areas": "kind"}.get(name)
    item = (lambda b: F.struct(_rounded(b["bbox"]).alias("bbox"), b[other].alias(other))) if other else _rounded
    return F.when(F.size(name) > 0, F.transform(name, item)).alias(name)


def _stored_fields(lists: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Stored fields of a node before and after its parts; empty ones are NULL and therefore left out of the JSON."""
    before = [
        F.col("number"), F.col("question_type"), F.col("text"), F.col("marks"), _rounded(F.col("bbox")).alias("bbox"),
        F.when(F.size("answer_options") > 0, F.col("answer_options")).alias("answer_options"),
    ]
    before += [_stored_list(c) for c in LISTS if c in lists and c != "answer_images"]
    after = [F.when(strip(F.col(c)) != "", F.col(c)).alias(c) for c in ("correct_answer", "marking_criteria")]
    return before, after + [_stored_list(c) for c in LISTS if c in lists and c == "answer_images"]


def question_structs(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One nested struct per top-level question: ``exam_id, path, doc``.

    The nodes of a question, which has no more than the letters and numerals of one printed number, meet in one
    aggregation and are nested from the top. A node below ``levels`` is an error. Lists of :data:`LISTS` that the nodes have are stored.
    """
    before, after = _stored_fields([c for c in LISTS if c in nodes.columns])
    path = F.when(F.size("path") <= levels, F.col("path")).otherwise(F.raise_error(F.lit("a node lies deeper than the stored levels")))
    flat = nodes.select("exam_id", _root(nodes).alias("_root"), F.struct(path.alias("path"), F.struct(*before).alias("before"), F.struct(*after).alias("after")).alias("_n"))
    names = [[f.name for f in flat.schema["_n"].dataType[part].dataType] for part in ("before", "after")]
    every = F.array_sort("_all", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    question = flat.groupBy("exam_id", "_root").agg(F.collect_list("_n").alias("_all")).withColumn("_all", every)

    def nested(node: Column, depth: int) -> Column:
        fields = [[node[part][n].alias(n) for n in ns] for part, ns in zip(("before", "after"), names, strict=True)]
        if depth < levels:
            below = F.filter("_all", lambda c: (F.size(c["path"]) == depth + 1) & (F.slice(c["path"], 1, depth) == node["path"]))
            fields[0].append(F.transform(below, lambda c: nested(c, depth + 1)).alias("subquestions"))
        return F.struct(*fields[0], *fields[1])

    tops = F.filter("_all", lambda c: F.size(c["path"]) == 1)
    return question.select("exam_id", F.explode(tops).alias("_top"), "_all").select("exam_id", F.col("_top.path").alias("path"), nested(F.col("_top"), 1).alias("doc"))


def _json(value: Column) -> Column:
    """JSON without empty lists of parts; inside a stored text the quotes of such a list would be escaped."""
    return F.replace(F.to_json(value), F.lit(',"subquestions":[]'), F.lit(""))


def question_documents(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One nested JSON document per top-level question: ``exam_id, path, doc``."""
    return question_structs(nodes, levels).withColumn("doc", _json(F.col("doc")))


def exam_documents(nodes: DataFrame, page_counts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One stored JSON document per exam: ``exam_id, raw`` with version, questions, totals and description.

    ``nodes`` carry ``is_leaf``; ``page_counts``: ``exam_id, page_count``, 0 where it is missing. An exam's list
    holds the numbered questions of one paper.
    """
    ordered = F.array_sort(F.collect_list(F.struct("path", "doc")), lambda a, b: F.when(a["path"] < b["path"], -1).otherwise(1))
    listed = question_structs(nodes, levels).groupBy("exam_id").agg(F.transform(ordered, lambda s: s["doc"]).alias("questions"))
    whole = listed.join(exam_summary(nodes), "exam_id").join(page_counts.select("exam_id", "page_count"), "exam_id", "left")
    envelope = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "questions", "total_marks", F.coalesce("page_count", F.lit(0)).alias("page_count"),
                        F.col("description").alias("raw_description"))
    return whole.select("exam_id", _json(envelope).alias("raw"))


def _unfolded(questions: Column, above: Column, levels: int) -> Column:
    """``array<struct<path, q>>`` of a stored list of questions and all that lies below, down to ``levels``."""
    def item(q: Column, i: Column) -> Column:
        path = F.concat(above, F.array((i + 1).cast("bigint")))
        own = F.array(F.struct(path.alias("path"), q.alias("q")))
        return F.concat(own, _unfolded(F.try_variant_get(q, "$.subquestions", "array<variant>"), path, levels - 1)) if levels > 1 else own

    none = F.expr("cast(array() as array<struct<path:array<bigint>,q:variant>>)")
    return F.coalesce(F.flatten(F.transform(questions, item)), none)


def _versioned(docs: DataFrame) -> DataFrame:
    parsed = docs.withColumn("_d", F.try_parse_json("raw"))
    return parsed.withColumn("_v", F.try_variant_get("_d", "$.schema_version", "int"))


def read_documents(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Stored trees ``exam_id, raw`` to node rows and rejects of another version.

    All levels of a document are read in one pass. Missing fields take their defaults; an empty answer falls back to the
    older field; options without a letter are dropped.
    """
    parsed = _versioned(docs)
    rejected = parsed.filter(F.col("_v").isNull() | (F.col("_v") != SCHEMA_VERSION)).select("exam_id", F.col("_v").alias("version"))
    every = _unfolded(F.try_variant_get("_d", "$.questions", "array<variant>"), F.expr("cast(array() as array<bigint>)"), levels)
    # A filter on the version would be moved below the parsed text and parse it again; documents of another one give no row.
    every = F.when(F.col("_v") == SCHEMA_VERSION, every)
    rows = parsed.select("exam_id", F.explode(every).alias("_n")).select("exam_id", "_n.path", "_n.q")
    # All fields are taken in one pass over the stored object; one that is of another type is NULL, as a missing one.
    fields = F.try_variant_get("q", "$", f"struct<{', '.join(f'{n}:{t}' for n, t in (STORED | LISTS).items())}>")
    rows = rows.select("exam_id", "path", fields.alias("f"))
    get = lambda p: F.col(f"f.{p}")
    answer = get("correct_answer")
    legacy = strip(F.coalesce(get("answer_key_text"), F.lit("")))
    options = F.filter(F.coalesce(get("answer_options"),
                                  F.expr("cast(array() as array<struct<letter:string,text:string>>)")),
                       lambda o: F.coalesce(o["letter"], F.lit("")) != "")
    box = F.struct(*[F.coalesce(get(f"bbox.{c}"), F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")],
                   F.coalesce(get("bbox.page"), F.lit(1)).alias("page"))
    nodes = rows.select(
        "exam_id", "path", get("number").alias("number"), F.coalesce(get("question_type"), F.lit(DEFAULT_TYPE)).alias("question_type"),
        F.coalesce(get("text"), get("content_summary"), F.lit("")).alias("text"), F.coalesce(get("marks"), F.lit(1)).alias("marks"),
        box.alias("bbox"), F.when(F.coalesce(strip(answer), F.lit("")) != "", answer).otherwise(F.nullif(legacy, F.lit(""))).alias("correct_answer"),
        get("marking_criteria").alias("marking_criteria"), options.alias("answer_options"),
        *[get(c).alias(c) for c in LISTS])
    return with_lists(nodes), rejected


def read_envelopes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``exam_id, total_marks, page_count, description`` of stored exams; a total of 0 is the sum of the leaves of ``nodes``."""
    good = _versioned(docs).filter(F.col("_v") == SCHEMA_VERSION)
    get = lambda p, t: F.try_variant_get("_d", f"$.{p}", t)
    sums = with_leaf_flag(nodes).filter("is_leaf").groupBy("exam_id").agg(F.sum("marks").alias("_sum"))
    return good.join(sums, "exam_id", "left").select(
        "exam_id", F.coalesce(F.nullif(get("total_marks", "bigint"), F.lit(0)), "_sum", F.lit(0)).alias("total_marks"),
        F.coalesce(get("page_count", "int"), F.lit(0)).alias("page_count"), F.coalesce(get("raw_description", "string"), F.lit("")).alias("description"))


# ---- readable outline -------------------------------------------------------------------------


def _prose(label: str, value: Column) -> Column:
    """``**label:** value``, several lines as a quotation."""
    body = strip(value)
    quoted = F.concat(F.lit(f"**{label}:**\n\n> "), F.replace(body, F.lit("\n"), F.lit("\n> ")))
    shown = F.when(F.contains(body, F.lit("\n")), quoted).otherwise(F.concat(F.lit(f"**{label}:** "), body))
    return F.when(body != "", F.concat(shown, F.lit("\n")))


def node_outline() -> Column:
    """Heading, stem, options and answers of one node as text."""
    level = F.least(F.size("path") + 2, F.lit(6))
    marks = F.when(F.col("marks") == 1, "1 mark").otherwise(F.concat(F.col("marks").cast("string"), F.lit(" marks")))
    kind = F.coalesce(F.nullif(strip(T.type_label(F.col("question_type"))), F.lit("")), F.lit("question"))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" Q"), "number", F.lit(" · "), kind, F.lit(" · "), marks, F.lit("\n"))
    # Answer lines of dots at the end of a stem are not part of the outline.
    stem = F.regexp_replace(F.regexp_replace("text", r"(?:(?:^|\n)\s*\.+\s*)+\z", ""), r"\s+\z", "")
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    rows = F.array_join(F.transform("answer_options", lambda o: F.concat(F.lit("| "), cell(o["letter"]), F.lit(" | "), cell(o["text"]), F.lit(" |"))), "\n")
    options = F.when(F.size("answer_options") > 0, F.concat(F.lit("**Options**\n\n| Letter | Text |\n|--------|------|\n"), rows, F.lit("\n")))
    return F.concat_ws("\n", heading, F.when(strip(F.col("text")) != "", F.concat(stem, F.lit("\n"))), options,
                       _prose("Answer", F.col("correct_answer")), _prose("Marking criteria", F.col("marking_criteria")))


def outline(nodes: DataFrame) -> DataFrame:
    """One section per top-level question; the sections of an exam follow each other by ``path``."""
    parts = F.array_sort(F.collect_list(F.struct("path", node_outline().alias("t"))))
    return (nodes.groupBy("exam_id", _root(nodes).alias("root"))
            .agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("section")))
