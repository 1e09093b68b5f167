"""Captioning whole folders: which backend and model answer, what they are asked, and a batch that can be stopped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import choices
from loomset.operators.answers import AnswerLog, scratch_log
from loomset.operators.batch import Pace, Retries


@dataclass(frozen=True)
class Stop:
    """A wish to stop, as a file that the driver and the executors see: in a shared folder on a cluster.

    A run starts by ``start``, or a wish left over from the run before would end it at once.
    """

    path: str

    def start(self) -> None:
        Path(self.path).unlink(missing_ok=True)

    def request(self) -> None:
        Path(self.path).touch()

    def __call__(self) -> bool:
        return Path(self.path).exists()


@dataclass(frozen=True)
class Backend:
    """A way to answer: ``opened(model, options)`` loads it and gives the function of a payload. ``kind`` is local, cloud, tagger or custom."""

    kind: str
    opened: Callable[[str, dict], Callable[[Any], str]]
    model: str = ""
    options: dict = field(default_factory=dict)


def chosen(backends: Mapping[str, Backend], key: str, default: str | None = None) -> Backend:
    """The backend of that key; an unknown key takes the default, and is an error where there is none."""
    if key not in backends and default is None:
        raise ValueError(f"no backend {key!r}; there are {', '.join(sorted(backends))}")
    return backends[key if key in backends else default]


def configured(backend: Backend, model: str = "", saved: Mapping | None = None, **changes: object) -> Backend:
    """The backend as a run uses it.

    A cloud backend takes the run's model, if it names one. A custom one takes model, address, key name and
    spacing from what the user saved, and is an error without an address. Changes that are set (not None)
    are laid over a tagger's options; they mean nothing to other backends.
    """
    options, name = dict(backend.options), backend.model
    if backend.kind == "custom":
        saved = saved or {}
        if not saved.get("base_url"):
            raise ValueError("the custom endpoint has no address yet: save a base_url and a model first")
        name = saved.get("model", "")
        options |= {"base_url": saved["base_url"], "api_key_env": saved.get("api_key_env", ""), "min_interval_s": saved.get("min_interval_s", 0.0)}
    elif backend.kind == "cloud":
        name = model.strip() or name
    elif backend.kind == "tagger":
        options |= {k: v for k, v in changes.items() if v is not None}
    return Backend(backend.kind, backend.opened, name, options)


def isolation(wanted: str, alpha: bool, default: str = "builtin", remote: str = "remote") -> str:
    """The backend that isolates; the remote one gives no transparency, and asking it for that is an error."""
    picked = wanted or default
    if picked == remote and alpha:
        raise ValueError("only the built-in backend cuts out with transparency: choose it, or a plain background")
    return picked


def instruction(style: Column, dataset_type: Column, sparse: Column, templates: Mapping[str, str], framings: Mapping[str, str], directives: Mapping[str, str], between: str = "") -> Column:
    """What a model is asked.

    Characters take the template of their style. Other types have a framing: it, what stands
    ``between``, and the style's directive make the text; ``sparse`` takes the framing "style-sparse",
    of styles alone. A style without a template or directive is prose.
    """

    def of(key: Column, texts: Mapping[str, str]) -> Column:
        known = F.lit(texts["prose"])
        for name, said in texts.items():
            known = F.when(key == name, said).otherwise(known)
        return known

    frame = F.when(dataset_type == "concept", framings["concept"]).when(sparse, framings["style-sparse"]).otherwise(framings["style"])
    composed = F.concat_ws(" ", frame, F.lit(between or None).cast("string"), of(style, directives))
    return F.when(dataset_type.isin("style", "concept"), composed).otherwise(of(style, templates))


def caption_images(
    rows: DataFrame, backend: Backend, payload: str = "content", style: str = "prose", skip_existing: bool = False, retries: Retries = Retries(),
    stop: Stop | None = None, keep: Callable[[int, str], None] | None = None, log: AnswerLog | None = None, pace: Pace | None = None, **finish: Any,
) -> DataFrame:
    """(ord, output, caption, status, error) for ``rows`` (ord, caption and the payload), in order.

    Each image is asked once: the answers go to ``log`` batch by batch, and the result is read from it. With
    the log of an earlier run, done, stopped or killed, only what that lacks is asked, and its answers are
    rows of this result too; without one, the log lives as long as the driver. A backend is loaded once for
    a task. The wish to stop is read before each call, so nothing is asked after it; rows that weren't
    reached are no rows of the result, and ``skip_existing`` leaves out what has a caption. ``keep(ord, output)``
    runs on the executor as soon as an answer is there, and again should its task be repeated: it has to
    write the same twice. A tagger gives tags, whatever the style; ``finish`` goes to
    ``choices.caption_steps``. Failures have no caption.
    """
    style = "tags" if backend.kind == "tagger" and style not in ("tags", "e621") else style
    todo = rows.where(F.trim(T.empty(F.col("caption"))) == "") if skip_existing else rows
    said = (log or scratch_log(rows.sparkSession)).ask(todo, "ord", payload, lambda: backend.opened(backend.model, backend.options), retries, stop, keep, pace)
    done = F.when(F.col("error") == "", choices.caption_steps(F.col("output"), style, **finish))
    return said.withColumn("caption", done).select("ord", "output", "caption", "status", "error").orderBy("ord")
