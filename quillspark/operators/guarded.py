"""Python converters whose failures stay with the document that caused them."""

import multiprocessing

from pyspark.sql import types as T

# Rows given to a function at once; less text is lost to a second try of a half.
ROWS = 64


def _texts(fn, pdf):
    """The function's Markdown for each row of a frame."""
    out = list(fn(pdf))
    if len(out) != len(pdf):
        raise ValueError(f"{len(out)} results for {len(pdf)} documents")
    if any(x is not None and not isinstance(x, str) for x in out):
        raise TypeError("a result is no text")
    return out


def _reason(name, exc):
    return f"{name} error: {str(exc) or type(exc).__name__}"


def halving(name, fn, pdf):
    """``(markdown, error)`` per row; a frame that raises is halved down to the row."""
    try:
        return [(x, f"{name} error: no Markdown" if x is None else None) for x in _texts(fn, pdf)]
    except Exception as exc:
        if len(pdf) == 1:
            return [(None, _reason(name, exc))]
    middle = len(pdf) // 2
    return halving(name, fn, pdf.iloc[:middle]) + halving(name, fn, pdf.iloc[middle:])


def _serve(name, fn, pipe):
    while True:
        pipe.send(halving(name, fn, pipe.recv())[0])


class Helper:
    """A child process that converts one document at a time, within a time limit.

    A document that hangs, or takes its process down, costs that process; the
    next document gets a new one.
    """

    def __init__(self, name, fn, seconds):
        self.name, self.fn, self.seconds, self.child = name, fn, seconds, None

    def convert(self, row):
        if self.child is None:
            context = multiprocessing.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.child = context.Process(target=_serve, args=(self.name, self.fn, theirs), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(row)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"{self.name} error: no answer within {self.seconds} seconds"
        except (EOFError, OSError):
            error = f"{self.name} error: the converter's process ended"
        self.stop()
        return None, error

    def stop(self):
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def guarded_frame(name, fn, seconds=None, rows=ROWS):
    """``fn`` as a ``DataFrame -> DataFrame`` converter that no document can stop.

    ``fn`` takes a pandas frame of documents (``file``, ``text`` and, where the
    source has it, ``content``) and gives one Markdown text per row. If it raises,
    the frame is halved until the row is found; that row gets an error, all others
    their Markdown. With ``seconds`` documents are converted one at a time in a
    child process of the task, and one that gives no answer in time is an error
    row too. A missing result is an error.
    """

    def frame(df):
        added = [T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]

        def run(batches):
            helper = Helper(name, fn, seconds) if seconds else None
            try:
                for batch in batches:
                    for begin in range(0, len(batch), rows):
                        some = batch.iloc[begin : begin + rows].reset_index(drop=True)
                        given = some[[c for c in ("file", "text", "content") if c in some]]
                        if helper:
                            done = [helper.convert(given.iloc[i : i + 1]) for i in range(len(given))]
                        else:
                            done = halving(name, fn, given)
                        yield some.assign(markdown=[m for m, _ in done], error=[e for _, e in done])
            finally:
                if helper:
                    helper.stop()

        return df.mapInPandas(run, T.StructType(df.schema.fields + added))

    return frame
