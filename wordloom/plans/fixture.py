"""The vocabulary of the registered queries.

It is a small one that is written down here, and behind it, where the file is at
hand, the lower-case words and word parts of a public vocabulary of some 50,000
tokens (``PUBLIC``; one line a token, base64 and rank).  Nothing is trained.  It
has no accented letters, so that the fallbacks are taken, and lacks some digits
and marks, so that unknown words occur.
"""

from __future__ import annotations

import base64
import os
import re
from dataclasses import replace
from functools import lru_cache

from ..sources.vocabulary import TokenizerModel, from_config

PUBLIC = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
MARKS = ". , ; : ! ? - ' \" ( ) / | _ = + *".split()
LETTERS = list("abcdefghijklmnopqrstuvwxyz0123456")
WORDS = (
    "the of and to in is it that for on with as was at by be this from are or an have not you with "
    "le la de et les des un une en dans que qui par pour sur au ou est il elle "
    "der die das und ist von zu mit den im ein eine nicht auf als auch "
    "el los una con del se su al y o ing tion ent her men ter ver"
).split()
PIECES = (
    "tion ing er an re th in on ed nd ha he st en nt ea or sh ti es is it ou wh bl ble ly the of and "
    "eau aux ment elle que ier ch ai oi eu tre pa la le vi sch ung heit keit ver ent ein be ge te lich "
    "ie un cion arr os as ar ll ita ado ente ere ene ant ion iere"
).split()


@lru_cache(maxsize=4)
def public_tokens(path: str) -> tuple[str, ...]:
    """Words, and word parts with their mark, of a file of ranks; none where there is no such file."""
    if not os.path.isfile(path):
        return ()
    with open(path, "rb") as file:
        tokens = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    return tuple(("" if t[:1] == b" " else "##") + t.strip().decode() for t in tokens if re.fullmatch(rb" ?[a-z]{1,16}", t))


def _config(path: str = PUBLIC) -> dict:
    vocab: dict[str, int] = {}
    for token in [*SPECIALS, *MARKS, *LETTERS, *WORDS, *(f"##{x}" for x in [*LETTERS, *PIECES]), *public_tokens(path)]:
        vocab.setdefault(token, len(vocab))
    return {
        "version": "1.0",
        "added_tokens": [{"id": vocab[t], "content": t, "single_word": False, "normalized": False} for t in SPECIALS],
        "normalizer": {"type": "BertNormalizer", "lowercase": True},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"special_tokens": {t: {"id": t} for t in ("[CLS]", "[SEP]")}},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "vocab": vocab},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
    }


@lru_cache(maxsize=4)
def model(form: str = "NFD", path: str = PUBLIC) -> TokenizerModel:
    """The model; with another form it normalises whole texts first."""
    return replace(from_config(_config(path)), form=form)


def vocab_lines(path: str = PUBLIC) -> list[str]:
    """The same vocabulary as the lines of a vocab.txt."""
    known = _config(path)["model"]["vocab"]
    return sorted(known, key=known.get)
