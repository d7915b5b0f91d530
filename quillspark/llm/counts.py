"""Token counts by dynamic programming over a trie of pre-tokens."""

from collections import deque

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lots, texts_of
from .pieces import Vocabulary

# Trie nodes a worker keeps; a full trie is emptied and grown anew.
NODES = 1_500_000
# A longer pre-token shares hardly any prefix with another one; it gets no nodes.
LONG = 1024


class CountTrie:
    """A trie of pre-tokens whose nodes hold unigram forward scores.

    ``best[n]`` is the score of the best segmentation of the prefix that ends at
    node n and ``count[n]`` its number of tokens. They depend on the prefix alone,
    so they are worked out once however many pre-tokens share it. Of equal scores
    the one with the longest last piece counts. ``terminal`` has the counts of
    whole pre-tokens. One of more than ``LONG`` characters goes through the same
    recurrence with the scores of the last few positions alone, so its memory does
    not grow with it, and is not kept.
    """

    def __init__(self, vocabulary, nodes=NODES):
        self.vocabulary, self.nodes = vocabulary, nodes
        self.clear()

    def clear(self):
        self.prune()
        self.terminal = {}

    def prune(self):
        """Drop the nodes; counts of whole pre-tokens stay."""
        self.child, self.best, self.count = {}, [0.0], [0]

    def rolled(self, word):
        """Tokens of a word from the scores of the last ``longest`` positions."""
        scores, longest, unknown = self.vocabulary.scores, self.vocabulary.longest, self.vocabulary.unknown
        past = deque([(0.0, 0)], longest)
        for end, c in enumerate(word, 1):
            value, tokens = past[-1][0] + unknown, past[-1][1] + len(c.encode("utf-8", "replace"))
            for begin, (before, spent) in enumerate(past, end - len(past)):
                score = scores.get(word[begin:end])
                if score is not None and before + score > value:
                    value, tokens = before + score, spent + 1
            past.append((value, tokens))
        return past[-1][1]

    def insert(self, word):
        scores, longest, unknown = self.vocabulary.scores, self.vocabulary.longest, self.vocabulary.unknown
        child, best, count = self.child, self.best, self.count
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            following = child.get((node, c))
            if following is None:
                value, tokens = best[node] + unknown, count[node] + len(c.encode("utf-8", "replace"))
                for begin in range(max(0, end - longest), end):
                    score = scores.get(word[begin:end])
                    if score is not None and best[path[begin]] + score > value:
                        value, tokens = best[path[begin]] + score, count[path[begin]] + 1
                following = len(best)
                child[(node, c)] = following
                best.append(value)
                count.append(tokens)
            node = following
            path.append(node)
        self.terminal[word] = count[node]

    def counts(self, texts):
        """(pre-tokens, tokens) of each text."""
        parts = [self.vocabulary.parts(t) for t in texts]
        for words in parts:
            new = set(words).difference(self.terminal)
            if len(self.best) > self.nodes:
                self.clear()
                new = set(words)
            long = [w for w in new if len(w) > LONG]
            for word in long:
                self.terminal[word] = self.rolled(word)
            for word in new.difference(long) if long else new:
                if len(self.best) > self.nodes:
                    self.prune()
                self.insert(word)
            found = len(words), sum(map(self.terminal.__getitem__, words))
            for word in long:
                del self.terminal[word]
            yield found


def count_tokens(docs, pieces, key="doc_id", text="text"):
    """``key, n_chars, n_pretokens, n_tokens`` of every row, from its whole text.

    Tries grow in the tasks, each under its own bound, so no text and no
    pre-token is moved; a pre-token of any length is counted whole. Null and empty texts have no tokens; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in ("n_chars", "n_pretokens", "n_tokens")]])
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    state = {}

    def each(batches):
        import pyarrow as pa

        trie = state.get("trie") or state.setdefault("trie", CountTrie(Vocabulary(shared.value)))
        for lot in lots(batches):
            texts = [t or "" for t in texts_of(lot.column(1))]
            found = list(trie.counts(texts))
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["k", "n_chars", "n_pretokens", "n_tokens"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)
