"""Feature extractors: what turns an item into something that can be compared."""

from __future__ import annotations

import importlib.util
import os
import shutil
import signal
import subprocess
import sys
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from kindred.functions.columns import params_digest

_known: dict[str, type] = {}


class ExtractionFailed(Exception):
    """The item is what it seems to be but can't be read, and won't be next time, unless transient."""

    def __init__(self, message: str = "", *, transient: bool = False):
        super().__init__(message)
        self.transient = transient


class ExtractorUnavailable(Exception):
    """A module or program is missing."""


class Extractor:
    """Subclass, set the class attributes, register.

    `extract(bytes)` gives features; `edges(features, queries, threshold)`
    gives rows (a, b, similarity). `similarity(a, b)` alone is enough for
    small collections: all pairs are compared then, in blocks. An index that
    pays within a block goes into `prepare`, and `similarities` asks it.
    """

    name = ""
    version = 0
    extensions: frozenset[str] = frozenset()
    modules: tuple[str, ...] = ()
    programs: tuple[str, ...] = ()
    needs_path = False
    default_params: dict = {}
    default_threshold = 0.9

    def __init__(self, **params):
        unknown = set(params) - set(self.default_params)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        self.params = {k: self._as(v, params[k]) if k in params else v for k, v in self.default_params.items()}
        self.validate(self.params)

    @staticmethod
    def _as(default, value):
        if isinstance(default, bool):
            if isinstance(value, str):
                word = value.strip().lower()
                if word not in {"1", "true", "yes", "on", "0", "false", "no", "off"}:
                    raise ValueError(f"{value!r} is not yes or no")
                return word in {"1", "true", "yes", "on"}
            return bool(value)
        return type(default)(value)

    def validate(self, params: dict) -> None:
        """Raise ValueError for values that make no sense."""

    @classmethod
    def check_programs(cls) -> str | None:
        """What is wrong with the programs found, if anything."""
        return None

    @classmethod
    def problem(cls) -> str | None:
        return _problem(cls)

    @property
    def digest(self) -> str:
        return params_digest(self.params)

    def extract(self, data: bytes) -> bytes:
        raise NotImplementedError

    def similarity(self, a: bytes, b: bytes) -> float:
        raise NotImplementedError

    def prepare(self, features: list[bytes]):
        """Whatever makes many comparisons with these features cheaper."""
        return features

    def similarities(self, query: bytes, prepared) -> list[float]:
        """The similarity of query to each of the features that were prepared, in their order."""
        return [self.similarity(query, x) for x in prepared]

    def edges(self, features: DataFrame, queries: DataFrame, threshold: float) -> DataFrame | None:
        return None


@cache
def _problem(cls: type[Extractor]) -> str | None:
    missing = [m for m in cls.modules if importlib.util.find_spec(m) is None]
    if missing:
        return f"needs {', '.join(missing)}"
    absent = [p for p in cls.programs if shutil.which(p) is None]
    if absent:
        return f"needs {', '.join(absent)} on PATH"
    return cls.check_programs()


def register(cls: type) -> type:
    """A later class of the same name replaces the earlier one."""
    if not (isinstance(cls, type) and issubclass(cls, Extractor)) or not cls.name or not isinstance(cls.version, int) or isinstance(cls.version, bool):
        raise TypeError("an extractor is a subclass of Extractor with a name and an int version")
    # executors can't import a module that only the driver has, such as a script's own
    module = sys.modules.get(cls.__module__)
    if module is not None and module.__name__.partition(".")[0] not in ("kindred", "__main__"):
        cloudpickle.register_pickle_by_value(module)
    _known[cls.name] = cls
    return cls


def extractors() -> dict[str, type]:
    return dict(sorted(_known.items()))


def get_extractor(name: str, **params) -> Extractor:
    cls = _known[name]
    if problem := cls.problem():
        raise ExtractorUnavailable(f"{name}: {problem}")
    return cls(**params)


def run_program(args: list[str], *, timeout: float, cancelled=lambda: False) -> subprocess.CompletedProcess:
    """Run a program in a process group of its own, which ends with it, at the timeout or when cancelled."""
    p = subprocess.Popen(args, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    waited = 0.0
    try:
        while True:
            try:
                out, err = p.communicate(timeout=0.2)
                return subprocess.CompletedProcess(args, p.returncode, out, err)
            except subprocess.TimeoutExpired:
                waited += 0.2
                if cancelled() or waited >= timeout:
                    raise
    finally:
        if p.poll() is None:
            os.killpg(p.pid, signal.SIGKILL)
            p.wait()
