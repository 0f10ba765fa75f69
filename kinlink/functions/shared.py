"""What the words and numbers of two records have in common, as one Arrow UDF: a text's sets are made once a batch, not once a pair."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.lexicon import ADDR_STOP

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

NAMES = ("name_jacc", "digit_jacc", "digit_any", "first_tok_eq", "len_diff", "phon_first_eq", "acronym_eq", "name_empty", "addr_rare_shared", "num_shared", "addr_contain", "name_contain")
STOP = frozenset(ADDR_STOP)


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _number(token: str) -> str:
    return token.lstrip("0") or "0"


def _core(text: str) -> tuple:
    """Words, the first, length, initials, the text without spaces."""
    t = _words(text)
    return frozenset(t), t[0] if t else None, len(text), "".join(w[0] for w in t), text.replace(" ", "")


def _address(text: str) -> tuple:
    """Words, numbers among the digits, numbers among the words, rare words."""
    a = _words(text)
    digits = frozenset(map(_number, re.findall(r"\d+", text)))
    numbers = frozenset(_number(w) for w in a if re.search(r"\d", w))
    return frozenset(a), digits, numbers, frozenset(w for w in a if len(w) >= 5 and w.isalpha() and w not in STOP)


def _first(text: str) -> str | None:
    return next(iter(_words(text)), None)


def _names(x: tuple, y: tuple) -> tuple:
    t, head, length, initials, flat = x
    u, head_, length_, initials_, flat_ = y
    shared = len(t & u)
    least, union = min(len(t), len(u)), len(t) + len(u) - shared
    acronym = len(initials) >= 2 and initials == flat_ or len(initials_) >= 2 and initials_ == flat
    return shared / union if union else 0.0, head == head_, abs(length - length_), acronym, (not length) + (not length_), shared / least if least else -1.0


def _addresses(x: tuple, y: tuple) -> tuple:
    a, digits, numbers, rare = x
    b, digits_, numbers_, rare_ = y
    shared = len(digits & digits_)
    least, union = min(len(a), len(b)), len(digits) + len(digits_) - shared
    return shared / union if union else -1.0, shared > 0, len(rare & rare_), len(numbers & numbers_), len(a & b) / least if least else -1.0


def _compared(make, compare, a: pa.Array, b: pa.Array) -> np.ndarray:
    """compare of what make makes of two columns' texts, a row a value that compare returns; each two different texts are compared once."""
    coded = pa.concat_arrays([a, b]).fill_null("").dictionary_encode()
    made = [make(t) for t in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    index = coded.indices.to_numpy().astype(np.int64)
    pairs, inverse = np.unique(index[: len(a)] * len(made) + index[len(a) :], return_inverse=True)
    found = np.array([compare(made[i], made[j]) for i, j in zip(*(k.tolist() for k in np.divmod(pairs, max(1, len(made)))))], np.float64)
    return (found[inverse] if len(found) else np.zeros((0, 6))).T


def _all(a_core, b_core, a_addr, b_addr, a_phon, b_phon):
    name = _compared(_core, _names, a_core, b_core)
    address = _compared(_address, _addresses, a_addr, b_addr)
    sound = _compared(_first, lambda x, y: (x == y,), a_phon, b_phon)
    columns = name[0], address[0], address[1], name[1], name[2], sound[0], name[3], name[4], address[2], address[3], address[4], name[5]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(NAMES))


def shared(*texts: Column) -> Column:
    """A struct of NAMES from both records' cores, addresses and sounds."""
    return F.arrow_udf(_all, "struct<" + ", ".join(f"{n}: double" for n in NAMES) + ">")(*texts)
