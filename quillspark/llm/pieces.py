"""The unigram vocabulary that token counts and piece encoding share."""

import math
import re

UNK = "<unk>"
SPACE = "▁"
# A text in front of which a space is set is cut before runs of spaces. No piece
# holds a space sign behind another sign, nor a line break, so the best path of a
# text is made of the best paths of these parts.
PART = re.compile(r"\n| *[^ \n]+| +")


class Vocabulary:
    """Pieces with log probabilities, and a way to spell any other character.

    The one public model at hand ranks its pieces by merges and has no unigram
    probabilities. Ranks are turned into them by Zipf's law: the piece of rank r
    has probability 1 / ((r + 1) H). A character that is no piece is spelled in
    byte pieces, at the price of ten below the rarest piece. ``ids`` and
    ``scores`` go by piece; pieces are written with plain spaces.
    """

    def __init__(self, pieces):
        """``pieces``: (text, id, rank or None for a byte piece)."""
        ranks = [r for _, _, r in pieces if r is not None]
        self.total = math.log(sum(1 / (r + 1) for r in ranks)) if ranks else 0.0
        self.scores, self.ids, self.bytes, self.text = {}, {}, {}, {}
        for text, number, rank in pieces:
            if rank is None:
                value = int(text[3:5], 16)
                self.bytes[value], self.text[number] = number, bytes([value])
                continue
            plain = text.replace(SPACE, " ")
            self.ids[plain], self.text[number] = number, plain.encode()
            self.scores[plain] = -math.log(rank + 1) - self.total
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        inner = [p for p in self.scores if "\n" in p or (p.strip(" ") and " " in p.lstrip(" "))]
        if inner:
            raise ValueError("pieces with inner spaces or line breaks are not supported")

    def parts(self, text):
        return PART.findall(" " + text) if text else []


def load_pieces(path):
    """(piece, id, rank) of a SentencePiece model file; control pieces are left out.

    The file is read where this is called, on the driver; tasks get the list.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append((model.id_to_piece(i), i, None))
        elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i), i))
    ranked = sorted((x for x in out if len(x) == 2), key=lambda x: (-model.get_score(x[1]), x[1]))
    return [x for x in out if len(x) == 3] + [(p, i, r) for r, (p, i) in enumerate(ranked)]
