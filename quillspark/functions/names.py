"""File names, output keys and output locations as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest stem kept as it is, the length a longer one is cut
# to, and the characters no common file store accepts.
MAX_STEM = 40
SHORT_STEM = 30
UNSAFE_CHARACTERS = r'[<>:"/\\|?*]'

# Everything up to the last dot, and the extension from there.
_SUFFIXED = r"(?s)\A(.+)(\.[^.]+)\z"


def url_path(url: Column) -> Column:
    """A URL without its query and fragment, so it reads like a file path."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def _without_slash(path: Column) -> Column:
    return F.when(
        F.endswith(path, F.lit("/")), F.left(path, F.length(path) - F.lit(1))
    ).otherwise(path)


def file_name(path: Column) -> Column:
    """Last path segment; one trailing slash is ignored."""
    return F.substring_index(_without_slash(path), "/", -1)


def file_parts(path: Column) -> Column:
    """``struct(name, stem, ext)``; the last inner dot starts the extension.

    A leading or a trailing dot starts none: ``.html`` and ``a.`` have no
    extension.
    """
    name = file_name(path)
    ext = F.regexp_extract(name, _SUFFIXED, 2)
    return F.struct(
        name.alias("name"),
        F.left(name, F.length(name) - F.length(ext)).alias("stem"),
        ext.alias("ext"),
    )


def parent_dir(path: Column) -> Column:
    """Everything before the last segment; ``.`` when there is nothing."""
    whole, name = _without_slash(path), file_name(path)
    parent = F.left(whole, F.length(whole) - F.length(name) - F.lit(1))
    return F.when(whole == name, ".").when(parent == "", "/").otherwise(parent)


def safe_name(stem: Column) -> Column:
    """Store-safe output key; only an over-long stem is cleaned and cut."""
    cleaned = F.regexp_replace(stem, UNSAFE_CHARACTERS, "_")
    return F.when(F.length(stem) > MAX_STEM, F.substring(cleaned, 1, SHORT_STEM)).otherwise(stem)


def output_location(file, requested, stem, mode="single", base_dir=None) -> Column:
    """``struct(output_dir, output_path)`` with the layout ``dir/stem/stem.md``.

    A requested directory wins. Otherwise a ``single`` file goes to its own
    parent, a ``folder`` to ``base_dir`` (the folder itself), an ``inbox`` to
    ``base_dir`` (the landing directory).
    """
    if mode == "single":
        default = parent_dir(file)
    elif mode in ("folder", "inbox"):
        if base_dir is None:
            raise ValueError(f"mode '{mode}' needs base_dir")
        default = F.lit(base_dir)
    else:
        raise ValueError(f"mode '{mode}' is not accepted; use one of single, folder, inbox")
    asked = F.when(F.length(requested) > 0, requested)
    directory = F.regexp_replace(F.coalesce(asked, default), r"([^/])/+\z", "$1")
    return F.struct(
        directory.alias("output_dir"),
        F.concat(
            F.when(directory == "/", "").otherwise(directory),
            F.lit("/"), stem, F.lit("/"), stem, F.lit(".md"),
        ).alias("output_path"),
    )
