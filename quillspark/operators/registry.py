"""Converters by name."""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..functions.formats import csv_columns, json_columns, text_columns, xml_columns
from ..functions.html import html_columns, tagless_columns
from .guarded import guarded_frame


@dataclass(frozen=True)
class Converter:
    """One converter.

    ``columns`` maps a text column to the pair ``(markdown, error)`` and runs
    inside the single pass over a batch. ``frame`` maps a DataFrame (``file``,
    ``text``, ``content`` where the source has it, and columns to pass through) to
    the same rows plus ``markdown`` and ``error``, and may use ``mapInPandas`` or a
    Pandas UDF; its rows take a branch, so one more scan, of their own. With
    neither, the name only claims its extensions. ``secondary`` is the ``(name, columns)``
    tried after an error, or where ``accepts``, if given, does not hold. ``fallback``
    names the registered converter that gets the rows a ``frame`` gave an error for.
    """

    name: str
    extensions: tuple
    rank: int = 100
    columns: Callable | None = None
    frame: Callable | None = None
    accepts: Callable | None = None
    secondary: tuple | None = None
    fallback: str | None = None


class ConverterRegistry:
    def __init__(self):
        self._converters = {}

    def add(self, converter: Converter) -> Converter:
        if not converter.name:
            raise ValueError("A converter needs a non-empty name")
        # Requests are lower-cased, so names are too.
        converter = replace(converter, name=converter.name.lower())
        self._converters[converter.name] = converter
        return converter

    def register_converter(self, name, exts, fn, rank=100, fallback=None) -> Converter:
        """Plug in a ``DataFrame -> DataFrame`` converter; a known name is replaced.

        Rows that it gives an error for go to the converter named ``fallback``.
        """
        return self.add(Converter(name, tuple(exts), rank, frame=fn, fallback=fallback))

    def register_function(self, name, exts, fn, rank=100, fallback=None, seconds=None) -> Converter:
        """Plug in a Python function over documents, guarded as in ``guarded_frame``."""
        return self.register_converter(name, exts, guarded_frame((name or "").lower(), fn, seconds), rank, fallback)

    def fallback_of(self, converter):
        """The converter that gets what ``converter`` failed on, or None."""
        if converter.fallback is None:
            return None
        second = self.get(converter.fallback.lower())
        if second is None or second.name == converter.name or not (second.columns or second.frame):
            raise ValueError(f"{converter.name} can't fall back to {converter.fallback}")
        return second

    def list_converters(self) -> list:
        """Names in order of first registration."""
        return list(self._converters)

    def converters(self) -> list:
        return list(self._converters.values())

    def get(self, name):
        return self._converters.get(name)

    def support_rows(self) -> list:
        return [
            (ext.lower(), c.name, c.rank) for c in self.converters() for ext in c.extensions
        ]

    def support(self, spark):
        """The registry as a small table (ext, engine, rank, place), by order of registration."""
        rows = [
            F.struct(F.lit(ext).alias("ext"), F.lit(engine).alias("engine"), F.lit(rank).alias("rank"), F.lit(place).alias("place"))
            for place, (ext, engine, rank) in enumerate(self.support_rows())
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))

    def engine_of(self, ext):
        """The lookup of ``support`` as an expression over an extension column.

        Of equal ranks the converter registered first has the extension.
        """
        best = {}
        for known, name, rank in self.support_rows():
            if known not in best or rank < best[known][0]:
                best[known] = (rank, name)
        extension, engine = F.lower(ext), F.lit(None).cast("string")
        for name in self.list_converters():
            exts = [known for known, (_, winner) in best.items() if winner == name]
            if exts:
                engine = F.when(extension.isin(exts), name).otherwise(engine)
        return engine


def default_registry() -> ConverterRegistry:
    """A registry with the built-in converters.

    ``pdf`` claims its extension ahead of every other converter but has no
    function: a parser for binary files is for the user to register.
    """
    registry = ConverterRegistry()
    registry.add(Converter("pdf", (".pdf",), rank=0))
    registry.add(
        Converter(
            "html", (".html", ".htm"), rank=10, columns=html_columns,
            secondary=("text", tagless_columns),
        )
    )
    registry.add(Converter("csv", (".csv",), rank=10, columns=csv_columns))
    registry.add(Converter("json", (".json",), rank=10, columns=json_columns))
    registry.add(Converter("xml", (".xml",), rank=10, columns=xml_columns))
    registry.add(Converter("text", (".txt",), rank=20, columns=text_columns))
    return registry


DEFAULT_REGISTRY = default_registry()


def register_converter(name, exts, fn, rank=100, fallback=None) -> Converter:
    return DEFAULT_REGISTRY.register_converter(name, exts, fn, rank, fallback)


def register_function(name, exts, fn, rank=100, fallback=None, seconds=None) -> Converter:
    return DEFAULT_REGISTRY.register_function(name, exts, fn, rank, fallback, seconds)


def list_converters() -> list:
    return DEFAULT_REGISTRY.list_converters()
