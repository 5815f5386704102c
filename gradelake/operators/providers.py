"""Reading models by the prefix of their name, asked in tasks and voted on only where several are wanted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions.replies import with_failed_record
from gradelake.operators import vote
from gradelake.operators.model_calls import EXTRACTION_PAUSES, call_once
from gradelake.session import staged
from gradelake.sources.records import Profile, read_records

Client = Callable[[dict], str]


@dataclass(frozen=True)
class Provider:
    """A kind of model: the prefixes of the models it serves, and ``client(model)``, called in each task."""

    name: str
    prefixes: tuple[str, ...]
    client: Callable[[str], Client]


_PROVIDERS: list[Provider] = []


def register(provider: Provider) -> Provider:
    """Adds a provider; one of the same name is replaced."""
    _PROVIDERS[:] = [p for p in _PROVIDERS if p.name != provider.name] + [provider]
    return provider


def provider_of(model: str) -> Provider:
    """The provider with the longest prefix of the model's name; the empty prefix serves all others."""
    fitting = [(len(prefix), p) for p in _PROVIDERS for prefix in p.prefixes if model.startswith(prefix)]
    if not fitting:
        raise ValueError(f"no provider for model {model!r}; known: {', '.join(p.name for p in _PROVIDERS) or 'none'}")
    return max(fitting, key=lambda f: f[0])[1]


def extracted(pages: DataFrame, model: str, profile: Profile, inputs: Sequence[str], folder: str, passes: int = 1,
              pauses: Sequence[float] = EXTRACTION_PAUSES, **calls) -> DataFrame:
    """Records ``page, pass, …`` of the profile, ``passes`` readings of every page by one model.

    ``pages``: ``page`` and ``inputs``. Replies are kept in ``folder``; a page without a usable one has the failed record.
    """
    client = provider_of(model).client
    asked = pages.select("page", *inputs).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    asked = asked.withColumn("model", F.lit(model))
    said = call_once(asked, lambda: client(model), [*inputs, "pass", "model"], folder, pauses, **calls)
    read = read_records(said.select("page", "pass", "raw", F.col("error").alias("why")), profile)
    return with_failed_record(read, F.col("parsed"), profile.answer_fields, F.col("why")).drop("parsed", "why")


def extract(pages: DataFrame, models: Sequence[str], profile: Profile, inputs: Sequence[str], folder: str, passes: int = 1, voting: bool = False, **calls) -> DataFrame:
    """One record per page: that of the first model, or with ``voting`` the vote of all models' readings.

    Without voting and with one pass a reading stays as it is; several passes of one model are put together by majority.
    """
    if voting:
        rows = None
        for number, model in enumerate(models):
            one = extracted(pages, model, profile, inputs, folder, passes, **calls).withColumn("pass", F.col("pass") + number * passes)
            rows = one if rows is None else rows.unionByName(one)
        # Each field is voted on in a branch of its own, which would read all replies anew.
        return vote.ensemble(staged(rows, "readings"), profile.answer_fields)
    rows = extracted(pages, models[0], profile, inputs, folder, passes, **calls)
    return rows.drop("pass") if passes == 1 else vote.multi_pass(rows, profile.fields, profile.answer_fields)
