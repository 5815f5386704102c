"""Personal data by fixed patterns, and by contexts that found entities induce."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import small_batches
from gradelake.session import staged, unstaged

KINDS = ("email", "ip", "card", "phone")
#: Different entities of one kind that a context needs, the least share of its occurrences that they make up, and the belief from which an unseen identifier counts.
SUPPORT, CONFIDENT, BELIEVED = 3, 0.6, 0.7
#: Decimals of a belief that is handed to the next round.
DECIMALS = 4
#: Words counted in a worker before the counts are handed on.
_COUNTED = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the start of a run of digits; looking behind spares the tries inside of it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_MORE = re.compile(r"(?: [0-9().+-]*[0-9][0-9().+-]*)+")
_SPACE = " \t\n\v\f\r"
_EDGE = "()[]{}<>\"'`.,;:!?*#$%&|="
_MASK = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address ends its local part at an @, so the search goes from one @ to the next."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans by the fixed patterns: kinds in order, each from left to right, in code points."""
    text = text or ""
    found = [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _masked(word: str) -> str:
    return word.encode("utf-8").translate(_MASK).decode("utf-8")


def _context(text: str, start: int, end: int) -> tuple[str | None, str | None]:
    """The whole words before and after a span that stands between white space, with digits masked."""
    left = right = None
    if start and text[start - 1] in _SPACE:
        stop = start
        while stop and text[stop - 1] in _SPACE:
            stop -= 1
        begin = stop
        while begin and text[begin - 1] not in _SPACE:
            begin -= 1
        left = _masked(text[begin:stop]) or None
    if end < len(text) and text[end] in _SPACE:
        begin = end
        while begin < len(text) and text[begin] in _SPACE:
            begin += 1
        stop = begin
        while stop < len(text) and text[stop] not in _SPACE:
            stop += 1
        right = _masked(text[begin:stop]) or None
    return left, right


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The spans, and runs of words with digits that no span touches, each with its context; the latter have no kind."""
    found, taken = [], sorted((s, e) for _, s, e in spans)
    for kind, s, e in spans:
        left, right = _context(text, s, e)
        found.append({"kind": kind, "start": s, "end": e, "value": text[s:e], "left": left, "right": right})
    free = at = 0
    for m in _DIGITS.finditer(text):
        if m.start() < free:
            continue
        start, end = m.start(), m.end()
        while start > free and text[start - 1] not in _SPACE:
            start -= 1
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        if more := _MORE.match(text, end):
            end = more.end()
        free = end
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        left, right = _context(text, start, end)
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        found.append({"kind": None, "start": start, "end": end, "value": text[start:end], "left": left, "right": right})
    return found


_ROWS = "key long, part boolean, base array<struct<kind:string,start:int,end:int>>, found array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>, words array<struct<word:string,n:long>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text its spans and mentions; now and then, the counts of the words read."""
    counts: dict[bytes, int] = {}
    names = ["key", "part", "base", "found", "words"]

    def counted() -> list:
        words = [{"word": w.decode("utf-8"), "n": n} for w, n in counts.items()]
        counts.clear()
        return [None, True, None, None, words]

    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            text = text or ""
            spans = base_spans(text)
            rows.append([key, False, [{"kind": k, "start": s, "end": e} for k, s, e in spans], mentions(text, spans), None])
            for word in text.encode("utf-8").translate(_MASK).split():
                counts[word] = counts.get(word, 0) + 1
            if len(counts) >= _COUNTED:
                rows.append(counted())
        out = pd.DataFrame(rows, columns=names)
        yield out.assign(key=out["key"].astype("Int64"))
    if counts:
        out = pd.DataFrame([counted()], columns=names)
        yield out.assign(key=out["key"].astype("Int64"))


def _state(known: DataFrame) -> tuple:
    """How many values are believed, and the sum of their beliefs in steps."""
    return tuple(known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.round(F.col("belief") * 10**DECIMALS).cast("long")), F.lit(0))).first())


def believe(seen: DataFrame, words: DataFrame) -> DataFrame:
    """``value, as_kind`` of unseen identifiers that confident contexts point to.

    ``seen`` has mentions ``kind, value, side, word``; ``words`` counts each ``word``. The graph joins values
    to contexts, a side and a word. A context's confidence in a kind is the belief in the values it stands
    with, summed over occurrences, divided by all occurrences of its word in the corpus, so a word of
    running text has none. It needs ``SUPPORT`` different values. A value's belief is one for a base entity
    of that kind, else 1 - product(1 - confidence) over its different confident contexts, which may round to
    one; a column of its own tells base entities apart. The rounds go on until no further value is believed, and no belief grows by a step of its last decimal (``DECIMALS``).
    """
    edges = seen.groupBy("value", "kind", "side", "word").agg(F.count(F.lit(1)).alias("n"))
    edges = staged(edges, "edges")
    known = staged(edges.where("kind is not null").select("value", F.col("kind").alias("as_kind"), F.lit(1.0).alias("belief"), F.lit(True).alias("base")).distinct(), "known")
    state, now = (0, 0), _state(known)
    while now[0] > state[0] or now[1] > state[1]:
        met = edges.join(known, "value").where("kind is null or kind = as_kind")
        mass = met.groupBy("side", "word", "as_kind").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"), F.count_distinct("value").alias("support"))
        contexts = mass.where(F.col("support") >= SUPPORT).join(words, "word").withColumn("confidence", F.least(F.col("mass") / F.col("n"), F.lit(1.0)))
        contexts = contexts.where(F.col("confidence") >= CONFIDENT).select("side", "word", "as_kind", "confidence")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        open_ = edges.where("kind is null").select("value", "side", "word").distinct().join(contexts, ["side", "word"])
        belief = open_.groupBy("value", "as_kind").agg((1 - F.exp(doubt)).alias("belief")).where(F.col("belief") >= BELIEVED)
        belief = belief.withColumns({"belief": F.round("belief", DECIMALS), "base": F.lit(False)})
        last, known = known, staged(known.where("base").unionByName(belief), "known")
        unstaged(last)
        state, now = now, _state(known)
    best = known.where("not base").groupBy("value").agg(F.max(F.struct("belief", "as_kind")).alias("best"))
    return best.select("value", F.col("best.as_kind").alias("as_kind"))


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` of each document: spans of the fixed patterns, and these with the discovered ones.

    Both are arrays of ``kind, start, end`` in code points, by kind in the order of ``KINDS``, then by start.
    Texts are read once and not shuffled; mentions, word counts and spans are. A null or empty text has no
    span; repeated keys keep their rows; no other column is read; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(_read, _ROWS)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "read")
    each = rows.where("not part").select("row", F.explode("found").alias("m")).select("row", "m.*")
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("word")), F.struct(F.lit("right").alias("side"), F.col("right").alias("word")))
    seen = each.select("kind", "value", F.explode(sides).alias("c")).select("kind", "value", "c.side", "c.word").where("word is not null")
    words = rows.where("part").select(F.explode("words").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("n"))
    # A context's mass and support never exceed its mentions, so none that could become confident in any round is left out.
    met = seen.groupBy("side", "word").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= SUPPORT)
    possible = staged(met.join(words, "word").where(F.col("met") / F.col("n") >= CONFIDENT).select("side", "word", "n"), "possible")
    new = believe(seen.join(possible.select("side", "word"), ["side", "word"], "left_semi"), possible.select("word", "n").distinct())
    more = each.where("kind is null").join(new, "value").groupBy("row").agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("more"))
    whole = rows.where("not part").select("row", "key", "base").join(more, "row", "left")
    return whole.select(F.col("key").alias(key), _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", F.coalesce("more", F.array()))).alias("spans"))


def _ordered(spans: Column) -> Column:
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
