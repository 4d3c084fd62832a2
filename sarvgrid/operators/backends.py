"""Pluggable models that mark tokens, as Arrow functions; and the audit that reads their marks.

A backend turns a text into marks (index, token, has_ezafe, confidence, raw_label). The neural backend of such pipelines
needs packages that are optional: asking for it without them is an error, never a silent pass.
"""

from __future__ import annotations

import importlib.util
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import OUTSIDE_LABELS

Mark = tuple[int, str, bool, float | None, str | None]
MARK = {"index": pa.int32(), "token": pa.string(), "has_ezafe": pa.bool_(), "confidence": pa.float64(), "raw_label": pa.string()}
MARKS = "array<struct<index:int,token:string,has_ezafe:boolean,confidence:double,raw_label:string>>"
REGISTRY: dict[str, Callable[[str], list[Mark]]] = {}

# Fixed values.
SCORES = ("kasreh_score", "kasreh_confidence", "score", "confidence")
SMOKE_PHRASE = "کتاب علی"
ADAPTER_KEY = r"layer_text_task_adapters\.([^.]+)\."
#: Left in a folder of models once a pipeline was loaded from it: half a download has none.
READY, READY_TEXT = ".pipeline_ok.v2", "pipeline_ok\nv2\n"
MODELS = "MODEL_CACHE_DIR"


def register(name: str) -> Callable:
    def keep(f: Callable[[str], list[Mark]]) -> Callable[[str], list[Mark]]:
        REGISTRY[name] = f
        return f

    return keep


@register("rule")
def rule(text: str) -> list[Mark]:
    """Marks a token which ends in a kasra or in ye after he; it has no confidence to give."""
    words = text.split()
    return [(i, w, w.endswith(("ِ", "ه‌ی")), None, "S-kasreh" if w.endswith(("ِ", "ه‌ی")) else "O") for i, w in enumerate(words)]


# folders of models


def models_dir(folder: str | None = None) -> str:
    """The folder of models: the one named, or the one in the environment. Relative ones are an error, as is none."""
    found = folder or os.environ.get(MODELS, "")
    if not found or not os.path.isabs(found := os.path.expanduser(found)):
        raise LookupError(f"an absolute folder of models is needed, by argument or in {MODELS}, not {found!r}")
    return found


def mark_ready(folder: str) -> str:
    """To be called once a pipeline was loaded and passed smoke_check()."""
    os.makedirs(folder, exist_ok=True)
    with open(path := os.path.join(folder, READY), "w", encoding="utf-8") as out:
        out.write(READY_TEXT)
    return path


def assert_ready(folder: str) -> None:
    """Models are whole if the marker says so; sizes of files are never a guess at it."""
    if not os.path.isdir(folder):
        raise LookupError(f"no folder of models at {folder}")
    if not os.path.isfile(os.path.join(folder, READY)):
        raise LookupError(f"{folder} has no {READY}: its models may be incomplete")


# documents of other libraries


def _of(thing: object, name: str) -> object:
    return thing.get(name) if isinstance(thing, dict) else getattr(thing, name, None)


def token_text(token: object) -> str:
    return next((v for v in (_of(token, n) for n in ("text", "word", "form")) if isinstance(v, str)), str(token))


def token_label(token: object) -> object:
    """The raw label, of the token or of its extensions (_)."""
    found = _of(token, "kasreh")
    return found if found is not None else getattr(getattr(token, "_", None), "kasreh", None)


def token_score(token: object) -> float | None:
    """A score between 0 and 1; none is not certainty."""
    found = next((v for v in (_of(token, n) for n in SCORES) if isinstance(v, int | float)), None)
    return None if found is None else min(1.0, max(0.0, float(found)))


def doc_tokens(doc: object) -> list[object]:
    """The tokens of a document: its own items, its tokens, or those of its sentences."""
    own = list(doc) if hasattr(doc, "__iter__") and not isinstance(doc, str | bytes | dict) else []
    if own and not isinstance(own[0], str | bytes):
        return own
    if found := getattr(doc, "tokens", None):
        return list(found)
    return [t for s in getattr(getattr(doc, "_", None), "sentences", None) or [] for t in getattr(s, "tokens", None) or []]


def parse_label(value: object) -> tuple[bool, str | None]:
    """(if it is positive, the label): anything but the labels for outside is, for the list of labels is open."""
    if value is None:
        return False, None
    text = ("S-kasreh" if value else "O") if isinstance(value, bool | int | float) else str(value).strip()
    return bool(text) and text.lower() not in OUTSIDE_LABELS and not text.lower().startswith("o-"), text or None


def doc_marks(doc: object) -> list[Mark]:
    found = [(token_text(t), *parse_label(token_label(t)), token_score(t)) for t in doc_tokens(doc)]
    return [(i, word, positive, score, label) for i, (word, positive, label, score) in enumerate(found)]


def smoke_check(detect: Callable[[str], list[Mark]], phrase: str = SMOKE_PHRASE) -> None:
    """A backend that marks nothing in a phrase that has a mark isn't sound; to be run on the driver before a job."""
    found = detect(phrase)
    if not any(m[2] for m in found):
        raise LookupError(f"the backend marks nothing in {phrase!r}: {found}")


def pipeline_backend(name: str, module: str, load: Callable[[object, str], Callable[[str], object]], folder: str | None = None) -> None:
    """Registers a backend whose pipeline is loaded once for each worker process, from a folder of models that must be ready.

    ``load`` makes the pipeline of the imported ``module`` and the folder. A module that isn't installed is an error here, at the driver.
    """
    if importlib.util.find_spec(module) is None:
        raise LookupError(f"{module} is not installed: there is no backend {name}")
    assert_ready(at := models_dir(folder))
    loaded: dict[str, Callable[[str], object]] = {}

    def detect(text: str) -> list[Mark]:
        if name not in loaded:
            loaded[name] = load(importlib.import_module(module), at)
        return doc_marks(loaded[name](text))

    REGISTRY[name] = detect


def adapter_mapping(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """source and target of the adapter weights in ``keys`` (name) whose task becomes the embedding's, among ``targets`` (name).

    Just one task must occur, and each of its keys must have a target: part of a mapping is refused.
    """
    told = keys.select("name", F.regexp_extract("name", ADAPTER_KEY, 1).alias("task")).where("task <> ''")
    tasks = sorted(r.task for r in told.select("task").distinct().limit(10).collect())
    if len(tasks) != 1:
        raise LookupError(f"one task of adapters is needed, found {tasks}")
    new = F.regexp_replace("name", ADAPTER_KEY.replace("([^.]+)", re.escape(tasks[0])), "layer_text_task_adapters.embedding.")
    both = told.select(F.col("name").alias("source"), new.alias("target")).join(targets.select(F.col("name").alias("_t")).distinct(), F.col("target") == F.col("_t"), "left")
    if lost := [r.source for r in both.where("_t IS NULL").orderBy("source").limit(5).collect()]:
        raise LookupError(f"a part of the mapping is refused: no target for {lost}")
    return both.select("source", "target")


def marks(text: Column, backend: str = "rule") -> Column:
    """Marks of each text; none for a blank one. A text is null where the backend failed on it."""
    if backend not in REGISTRY:
        raise LookupError(f"backend {backend} is not installed")
    detect = REGISTRY[backend]

    # marks go out as five columns and where each text's begin: a dictionary a mark takes most of the time of a simple backend
    @F.arrow_udf(MARKS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, starts = [], []
            for t in texts.to_pylist():
                try:
                    own = [(i, token, has, sure, label) for i, token, has, sure, label in detect(t)] if t and t.strip() else []
                except Exception:  # noqa: BLE001  one text's failure is its own unknown
                    starts.append(None)
                else:
                    starts.append(len(found))
                    found += own
            columns = zip(*found, strict=True) if found else [()] * len(MARK)
            cells = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, MARK.values(), strict=True)], list(MARK))
            yield pa.ListArray.from_arrays(pa.array([*starts, len(found)], pa.int32()), cells)

    return run(text)


def audit(rows: DataFrame, backend: str = "rule", enabled: bool = False) -> DataFrame:
    """Findings of ``rows`` (id, text): one for each positive mark; where the check is off or failed, one that is skipped."""
    some = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if not enabled:
        return some.select("id", F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("token"), F.lit(True).alias("skipped"), F.lit("disabled").alias("skip_reason"))
    found = some.select("id", marks(F.col("text"), backend).alias("m"))
    # one pass of the backend: a failed text has one finding without a mark
    each = F.when(F.col("m").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("token"), F.lit(True).alias("skipped"))))
    each = each.otherwise(F.transform(F.filter("m", lambda x: x["has_ezafe"]), lambda x: F.struct(x["index"].alias("index"), x["token"].alias("token"), F.lit(False).alias("skipped"))))
    return found.select("id", F.inline(each)).select("id", "index", "token", "skipped", F.when(F.col("skipped"), "backend_error").alias("skip_reason"))
