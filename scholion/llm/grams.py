"""Words as sets of positional q-grams: keys by which words that differ by one error meet.

A word is cut into three disjoint grams with their places. One letter changed, left out or put in spoils one of them, so
two stand whole in the other word, moved by one place at most; pairs of grams are the prefix by which words are indexed
and probed. Neighbours exchanged within a gram spoil only that; for those that stand in two grams, the probe exchanges
them back. So every pair within an error meets, at any length, and by two thirds of its letters.

Two errors leave one of the three grams whole, moved by two places at most. One gram says little, so words that may have two
errors are indexed and probed by a gram together with a word that must agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = ((0, 1), (0, 2), (1, 2))


def _places(length: Column) -> list[tuple[Column, Column]]:
    """(start, size) of the three disjoint grams of a word of ``length`` letters; they cover it."""
    q, rest = F.floor(length / 3).cast("int"), length % 3
    second = q + (rest == 2).cast("int")
    return [(F.lit(1), q), (1 + q, second), (1 + q + second, q + (rest >= 1).cast("int"))]


def _key(kind: Column, word: Column, length: Column, pair: tuple[int, int], moves: tuple[int, int] = (0, 0)) -> Column:
    """A pair of the grams that a word of ``length`` letters has, read in ``word`` with the moves given."""
    grams = [F.substring(word, at + move, size) for (at, size), move in zip((_places(length)[k] for k in pair), moves)]
    return F.xxhash64(kind, length, F.lit(str(pair)), *grams)


def index_grams(kind: Column, word: Column) -> Column:
    """The pairs of grams of a word; words of less than three letters have none."""
    n = F.length(word)
    return F.when(n >= 3, F.array(*(_key(kind, word, n, p) for p in PAIRS)))


def probe_grams(kind: Column, word: Column) -> Column:
    """The pairs of grams by which a word meets the index of every word within one error that isn't longer."""
    n = F.length(word)
    same = [_key(kind, word, n, p) for p in PAIRS]
    shorter = [_key(kind, word, n - 1, p, tuple(int(k == 2 or (k == 1 and p == (1, 2))) for k in p)) for p in PAIRS]
    swapped = []
    for at, _ in _places(n)[1:]:
        back = F.concat(F.substring(word, F.lit(1), at - 2), F.substring(word, at, F.lit(1)), F.substring(word, at - 1, F.lit(1)), F.substring(word, at + 1, n))
        swapped.append(_key(kind, back, n, (0, 1)))
    return F.when(n > 3, F.array(*same, *swapped, *shorter)).when(n == 3, F.array(*same, *swapped))


#: Moves of the grams 1, 2 and 3, by the length a word has beyond another, of which two errors leave one right.
#: Of words of equal length each probes the other, so a move to the left of the one is found as one to the right of the other.
_TWO = {0: ((0, 0), (1, 0), (1, 1), (2, 0)), 1: ((0, 0), (1, 0), (1, 1), (2, 1)), 2: ((0, 0), (1, 1), (2, 2))}


def index_two(beside: Column, word: Column) -> Column:
    """The grams of a word of three letters or more, each with the word ``beside`` it."""
    n = F.length(word)
    return F.array(*(F.xxhash64(beside, n, F.lit(k), F.substring(word, at, size)) for k, (at, size) in enumerate(_places(n))))


def probe_two(beside: Column, word: Column, least: int) -> Column:
    """The grams by which a word meets the ``index_two`` of every word within an edit distance of two that isn't longer and has ``least``
    letters or more; of two words of equal length one meets the other."""
    n = F.length(word)
    out = []
    for less, moves in _TWO.items():
        places = _places(n - less)
        out += [F.when(n - less >= least, F.xxhash64(beside, n - less, F.lit(k), F.substring(word, places[k][0] + move, places[k][1]))) for k, move in moves]
    return F.array_compact(F.array(*out))


def letter_counts(word: Column) -> Column:
    """A word's letters as bits: one for a letter that occurs, one more for a second time."""

    def enter(bits: Column, letter: Column) -> Column:
        at = (F.ascii(letter) % 32 * 2).cast("int")
        once = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        return bits.bitwiseOR(F.when(bits.bitwiseAND(once) == 0, once).otherwise(F.call_function("shiftleft", F.lit(2).cast("bigint"), at)))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), enter)


def letters_allow(a: Column, b: Column, errors: int) -> Column:
    """Whether words of these ``letter_counts`` can be within ``errors``: one changes two bits at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * errors


def letter_bags(beside: Column, word: Column) -> Column:
    """Keys of the letters a word is made of, all and without any one of them, each with the word ``beside`` it; words that have an
    exchange of neighbours and at most one other error between them share one."""
    letters = F.split(word, "")
    value = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))
    total = F.aggregate(letters, F.lit(0).cast("bigint"), lambda t, c: t + value(c))
    return F.transform(F.array_append(F.transform(F.array_distinct(letters), lambda c: total - value(c)), total), lambda x: F.xxhash64(beside, x))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), f), 0)


def exchanged_and_one_error(a: Column, b: Column) -> Column:
    """More than two edits apart, but equal up to one error once two neighbours of ``a`` are exchanged."""
    n = F.length(a)
    back = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.reverse(F.substring(a, i, F.lit(2))), F.substring(a, i + 2, n))
    close = (F.abs(n - F.length(b)) <= 1) & F.levenshtein(a, b, 4).between(3, 4) & letters_allow(letter_counts(a), letter_counts(b), 1)
    return close & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: let(back(i), lambda x: one_error(x, b, 2)))


def exchanged(a: Column, b: Column) -> Column:
    """Whether two neighbouring letters are exchanged, and all else is equal."""
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    two = F.lit(2)
    return (n == F.length(b)) & let(differ, lambda at: (F.size(at) == 2) & (F.get(at, 1) == F.get(at, 0) + 1) & (F.substring(a, F.get(at, 0), two) == F.reverse(F.substring(b, F.get(at, 0), two))))


def one_error(a: Column, b: Column, least: int) -> Column:
    """Equal but for one letter changed, left out or put in, or two neighbours exchanged; both of ``least`` letters or more."""
    return (F.least(F.length(a), F.length(b)) >= least) & let(F.levenshtein(a, b, 2), lambda d: d.between(0, 1) | ((d == 2) & exchanged(a, b)))


def two_errors(a: Column, b: Column, least: int) -> Column:
    """Within an edit distance of two; both of ``least`` letters or more."""
    return (F.least(F.length(a), F.length(b)) >= least) & F.levenshtein(a, b, 2).between(0, 2)
