"""Segmentation models as methods for ``staining.segment``: each builder returns a callable from an image (C, Y, X) to a mask.

The libraries are needed on the executors only, where a model is loaded once a
Python worker, not once a patch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MissingLibrary(ImportError):
    """A model's library isn't installed where it runs."""


def _library(name: str):
    from importlib import import_module

    try:
        return import_module(name)
    except ImportError as e:
        raise MissingLibrary(f"{name} must be installed on the executors") from e


def _once(make: Callable):
    """``make()`` at the first call in a worker."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def default_min_area(diameter: float) -> float:
    """The least area of a cell of a given diameter that is kept."""
    return (diameter / 2) ** 2


def cellpose(diameter: float, channels: list[str], model_type: str = "cyto3", pretrained_model: str | None = None, gpu: bool = False, flow_threshold: float = 2, cellprob_threshold: float = -6, model_options: dict | None = None, **options) -> Callable[[np.ndarray], np.ndarray]:
    """One channel is read as gray; two are the cell's and then the nucleus's. From version 4 on a pretrained model is needed, ``cpsam`` unless named."""
    if len(channels) not in (1, 2):
        raise ValueError(f"one or two channels are needed, not {len(channels)}")
    planes = [0, 0] if len(channels) == 1 else [1, 2]

    def load():
        library, models = _library("cellpose"), _library("cellpose.models")
        version = str(getattr(library, "version", "0"))
        name = pretrained_model or ("cpsam" if version.split(".")[0].isdigit() and int(version.split(".")[0]) >= 4 else None)
        if name:
            return models.CellposeModel(gpu=gpu, pretrained_model=name, **(model_options or {}))
        return models.Cellpose(gpu=gpu, model_type=model_type, **(model_options or {}))

    model = _once(load)

    def run(image: np.ndarray) -> np.ndarray:
        return model().eval(image, diameter=diameter, channels=planes, flow_threshold=flow_threshold, cellprob_threshold=cellprob_threshold, **options)[0]

    return run


def stardist(model_type: str = "2D_versatile_he", local_model: str | None = None, prob_thresh: float = 0.2, nms_thresh: float = 0.6, **options) -> Callable[[np.ndarray], np.ndarray]:
    """A model by its public name, or from a folder that every executor can read."""

    def load():
        kind = _library("stardist.models").StarDist2D
        if local_model is None:
            return kind.from_pretrained(model_type)
        folder = Path(local_model).absolute()
        if not folder.is_dir():
            raise FileNotFoundError(folder)
        return kind(None, name=folder.name, basedir=str(folder.parent))

    model = _once(load)

    def run(image: np.ndarray) -> np.ndarray:
        bright = _library("csbdeep.utils").normalize(image.transpose(1, 2, 0), clip=True)
        return model().predict_instances(bright, prob_thresh=prob_thresh, nms_thresh=nms_thresh, **options)[0]

    return run


BUILDERS: dict[str, Callable] = {"cellpose": cellpose, "stardist": stardist}
