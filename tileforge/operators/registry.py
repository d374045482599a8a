"""Extensions by name: preprocess steps, augmentations, metrics, losses, readers and writers.

A spec is a name, or a dict of one name and its arguments. Functions take and give what Spark composes: preprocess steps map a
Column to a Column, augmentations a DataFrame to a DataFrame, metrics and losses make Columns (the losses of tile pairs take and give a
DataFrame), readers make DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import pixels
from ..sources import files
from . import evaluate, sampling, scoring

KINDS = ("preprocess", "augmentation", "metric", "loss", "reader", "writer")
_known: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, function: Callable) -> None:
    """Later registrations of a name win."""
    if kind not in _known:
        raise ValueError(f"unknown kind {kind}")
    _known[kind][name] = function


def find(kind: str, name: str) -> Callable:
    if name not in _known.get(kind, {}):
        raise ValueError(f"unknown {kind} {name}")
    return _known[kind][name]


def parse(spec: str | dict) -> tuple[str, dict]:
    if isinstance(spec, str):
        return spec, {}
    if len(spec) != 1:
        raise ValueError("a spec has one name")
    name, args = next(iter(spec.items()))
    return name, dict(args or {})


def make(kind: str, spec: str | dict, *first):
    """Calls the function of the spec with ``first`` and the spec's arguments."""
    name, args = parse(spec)
    return find(kind, name)(*first, **args)


for _name, _step in {**pixels.STEPS, "gauss_mult_noise": pixels.gauss_mult_noise, "substitute": pixels.substitute}.items():
    register("preprocess", _name, _step)
for _name, _change in sampling.AUGMENTATIONS.items():
    register("augmentation", _name, _change)
for _name, _metric in {"recall": evaluate.recall_of, "precision": evaluate.precision_of, "binary_accuracy": evaluate.accuracy_of}.items():
    register("metric", _name, _metric)
for _name, _loss in {"binary_cross_entropy": evaluate.binary_cross_entropy, "categorical_cross_entropy": evaluate.categorical_cross_entropy, "dice": evaluate.dice_loss, "focal": evaluate.focal_loss, "ms_ssim": scoring.ms_ssim_loss, "ms_ssim_mse": scoring.ms_ssim_mse_loss, "surface": scoring.surface_loss}.items():
    register("loss", _name, _loss)
register("reader", "npy", files.read_npy)
register("reader", "elevation", files.read_elevation)
register("writer", "tiles", files.write_tiles)
