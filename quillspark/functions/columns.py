"""Column names that clash with none of a table."""


def unused(name: str, *frames) -> str:
    """``name``, or the same behind underscores until no frame has such a column."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
