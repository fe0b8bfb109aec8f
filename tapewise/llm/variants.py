"""Words that differ by one edit, found by scanning sorted lists with an edit matrix whose rows neighbours share.

The vocabulary is dealt into sorted lists of words that agree but for one stretch of places: an edit lies in one half of a word, so the other half is
shared. Lists longer than LIST are split again by halving the stretch; when it is one place, a list has no more words than the alphabet has
letters. Each list is scanned by each of its words: rows of the banded edit matrix are kept for the prefix that a
word shares with the one before it, and words that share a prefix already more than one edit away are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, cut, looked_up, with_totals

#: Letters of a word, and the ones that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Longest list that is scanned as it is; more than the letters there are, so splitting ends.
LIST = 160
#: A form is at least so many times as frequent.
RATIO = 2


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word): every maximal run of letters of every whole text, A-Z lower-cased; null texts have none. Rows without a key keep a null one."""
    lowered = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    return docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of the words (column ``word``) that are long and frequent enough; counted in each task first."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_in_list(words: list[str], counts: list[int], lo: int, hi: int, longest: int) -> tuple[list[int], list[tuple[int, str] | None]]:
    """Number of near words of each word of a sorted list, and the best of them as (-n, word).

    The words share their first ``lo`` letters and what follows place ``hi`` of the longest. A pair counts here if one of the two has length ``longest`` and
    they first differ in lo..hi-1: so each pair counts in one list only.
    """
    size = len(words)
    shared = [0] * (size + 1)
    for k in range(1, size):
        a, b, d = words[k - 1], words[k], lo
        least = min(len(a), len(b))
        while d < least and a[d] == b[d]:
            d += 1
        shared[k] = d
    near, best = [0] * size, [None] * size
    rows = [(1, 0, 1)] * (longest + 2)  # per letters read of the scanned word: edits to its own length - 1, + 0 and + 1 letters of the query
    for i in range(size - 1):
        query = words[i] + "\0\0"
        length, depth, j, first = len(words[i]), lo, i + 1, longest
        while j < size:
            depth = min(depth, shared[j])
            first = min(first, shared[j])  # letters that the query shares with the scanned word
            if first >= hi:
                j += 1
                continue
            word, alive = words[j], True
            while depth < len(word):
                a, b, c = rows[depth]
                letter = word[depth]
                x = min(a + (depth == 0 or query[depth - 1] != letter), b + 1)
                y = min(b + (query[depth] != letter), c + 1, x + 1)
                z = min(c + (query[depth + 1] != letter), y + 1)
                depth += 1
                rows[depth] = (x, y, z)
                if x > 1 and y > 1 and z > 1:
                    alive = False
                    break
            if alive:
                apart = length - len(word)
                if -1 <= apart <= 1 and rows[depth][apart + 1] == 1 and (length == longest or len(word) == longest):
                    near[i] += 1
                    near[j] += 1
                    one, other = (-counts[j], word), (-counts[i], words[i])
                    if best[i] is None or one < best[i]:
                        best[i] = one
                    if best[j] is None or other < best[j]:
                        best[j] = other
                j += 1
            else:
                j += 1
                while j < size and shared[j] >= depth:  # the same prefix, which is too far away
                    first = min(first, shared[j])
                    j += 1
    return near, best


def _scan_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for words, counts, lo, hi, longest in zip(batch["words"], batch["counts"], batch["lo"], batch["hi"], batch["longest"]):
            words, counts = list(words), [int(n) for n in counts]
            near, best = near_in_list(words, counts, int(lo), int(hi), int(longest))
            out += [(w, n, -b[0], b[1]) for w, n, b in zip(words, near, best) if b is not None]
        yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of every word of a vocabulary (word, n) that has a near word: how many, and the most frequent one.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; of equally frequent ones the smallest in code-point order is the
    form. Words must be distinct and not null.
    """
    work = Workspace(words.sparkSession, "variants")
    length = F.col("longest") - F.length("word")  # 0 or 1
    rest = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longest")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("longest"))
    at = ["longest", "lo", "hi", "key"]
    scanned: DataFrame | None = None
    level = 0
    while True:
        middle = (F.col("lo") + F.col("hi")).cast("int")
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.floor(middle / 2).cast("int").alias("hi")),
            F.struct(F.floor(middle / 2).cast("int").alias("lo"), F.col("hi").alias("hi")),
        )
        dealt = rest.select("word", "n", "longest", F.explode(halves).alias("part")).select("word", "n", "longest", "part.lo", "part.hi").where("lo < hi")
        tail = F.when(F.col("longest") > F.col("hi"), F.expr("right(word, longest - hi)")).otherwise("")
        dealt = work.write(dealt.withColumn("key", F.concat(F.expr("left(word, lo)"), F.lit("\0"), tail)), f"dealt{level}")
        sizes = {"size": (F.count("*"), F.sum), "long": (F.count_if(length == 0), F.sum)}
        sized = with_totals(dealt, at, "word", sizes).where("size > 1 and long > 0")
        lists = sized.where((F.col("size") <= LIST) | (F.col("hi") - F.col("lo") <= 1)).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
        lists = lists.select(F.col("w.word").alias("words"), F.col("w.n").alias("counts"), "lo", "hi", "longest")
        part = work.write(lists.mapInPandas(_scan_lists, "word string, n_near long, form_n long, form string"), f"near{level}")
        scanned = part if scanned is None else scanned.unionByName(part)
        rest = work.write(sized.where((F.col("size") > LIST) & (F.col("hi") - F.col("lo") > 1)).drop("key", "size", "long"), f"rest{level}")
        work.drop(f"dealt{level}", *([f"rest{level - 1}"] if level else []))
        if rest.isEmpty():
            break
        level += 1
    best = scanned.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form or null, ...) with ``root``: where following the forms ends, the word itself if it has none.

    Pointers are doubled until nothing changes; a root that many words share is spread over tasks. Forms must not run in circles, as
    those of growing frequency don't.
    """
    now = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(looked_up(now, further, ["root"], "word").select("word", F.coalesce("_next", "root").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")))
        now = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return forms.join(now, "word")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    ``form`` is the word's most frequent near word if that is at least RATIO times as frequent as the word, else null, and ``form_n`` its
    number; ``root`` is where following the forms ends. An empty vocabulary gives an empty table; ties go to the smaller word. Work and shuffles grow with the
    vocabulary, not with the texts.
    """
    known = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    known = Workspace(words.sparkSession, "forms").write(known, "all")
    return roots(known).select("word", "form", "root", "n", "n_near", "form_n")
