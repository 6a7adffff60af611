"""Problem 5: texts cut off before their last sentence is complete.

Method, in built-in SQL expressions only: word trigrams are counted inside the texts and at their ends; each
text's final trigram is joined, and a text is cut where its final trigram is frequent inside texts but almost
never ends one. A trigram of words that is too rare to tell (names, numbers, half words) is asked for as a trigram of
classes (a capitalised word, a number, a lower-case word of six letters or more; shorter words, punctuation and line
breaks stand for themselves), then with its last word as any word, then the bigram decides, then the last token. Each
text is judged by the others' ends, not by its own; equal texts are counted once and judged as one, so that copies don't
speak for each other. Half a word may stand at the ends of very many texts: a gram that is seen at ends only is no
evidence where the places in which its last word goes on are far more. A text that ends in a full stop, a question or exclamation mark or a quotation isn't cut; a mark
that stands for a missing rest (an ellipsis, a broken entity or tag, a replacement character) decides at once.

Null, empty and blank texts are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, materialise

#: A gram must be seen so often in other places to decide.
MIN_SEEN = 30
#: Or end so many other texts.
MIN_ENDED = 2
#: A short word is half of a longer one if it stands inside so small a share of the longer one's texts.
HALF_WORD_SHARE = 0.01
#: A trigram of words ends texts often if it ends at least so many others, and this share of its places; in between the classes tell.
OFTEN_ENDED = 3
OFTEN_SHARE = 0.05
#: A gram that ends a text in at most this share of its occurrences is "almost never terminal".
MAX_TERMINAL_SHARE = 0.006

# Tokens that end a sentence; what an unfinished text ends with when its rest was taken off by a program.
_STOPS = (".", "!", "?", '"')
_MISSING_REST = (
    r"(?:…|\.\.\.|�|\[\s*…\s*\]|\[\+\d+ chars\]|\[cont(?:\.|inued)?\]|\(cont(?:\.|inued)?\)?|&#?\w{1,7};?|\\u[0-9a-fA-F]{0,4}|\\x[0-9a-fA-F]{0,2}|<!--|</?[A-Za-z]*(?:\s[^<>]*)?|read more|continue reading|\p{N},)\s*$"
)


#: A word, a number, a line break or a mark. Words that begin with Latin letters, which most do, are tried first.
_LATIN = r"a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_TOKEN = rf"[{_LATIN}]++[\p{{L}}\p{{M}}]*+(?:'\p{{L}}++)*+|[\p{{L}}\p{{M}}]++(?:'\p{{L}}++)*+|\p{{N}}++(?:[.,:]\p{{N}}++)*+|\n|[^\s\p{{L}}\p{{M}}\p{{N}}]"


def tokens_of(text: Column) -> Column:
    """The text's tokens, after two line breaks that stand for its beginning."""
    return F.regexp_extract_all(F.concat(F.lit("\n\n"), F.trim(F.translate(text, "“”„«»’", "\"\"\"\"\"'"))), F.lit(_TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return F.substring(token, 1, 1).between("0", "9")


def class_of(token: Column) -> Column:
    """The class of a token, or the token itself."""
    first = F.substring(token, 1, 1)
    return F.when(first.between("a", "z") & (F.length(token) < 6), token).when(_is_number(token), F.lit("9")).when(F.lower(first) != first, F.lit("X")).when(F.length(token) >= 6, F.lit("xx")).otherwise(token)


def token_classes(text: Column) -> Column:
    return F.transform(tokens_of(text), class_of)


def _trigrams(texts: DataFrame) -> DataFrame:
    """(wa, wb, wc): each trigram of words of each text."""
    n = F.greatest(F.size("t") - 2, F.lit(0))
    zipped = F.arrays_zip(F.slice("t", 1, n).alias("a"), F.slice("t", 2, n).alias("b"), F.slice("t", 3, n).alias("c"))
    return texts.select(tokens_of(F.col("text")).alias("t")).select(F.explode(zipped).alias("g")).select("g.a", "g.b", "g.c").toDF(*_WORDS)


_WORDS = ("wa", "wb", "wc")


def _counted(own: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, c, n), (id, n)): the trigrams of classes of all texts, and those of words that are asked for (wa, wb, wc, id).

    Both are counted in one pass over the texts, and combined before they are shuffled, so that a frequent one is no hot key.
    Only if more are asked for than are broadcast, the trigrams of words are all counted in a pass of their own.
    """
    count = F.count(F.lit(1)).alias("n")
    each = _trigrams(own)
    classes = [class_of(F.col(w)).alias(c) for w, c in zip(_WORDS, "abc", strict=True)]
    if asked.count() > BROADCAST_ROWS:
        return each.select(*classes).groupBy("a", "b", "c").agg(count), each.groupBy(*_WORDS).agg(count).join(asked, list(_WORDS)).select("id", "n")
    # found by a number, and then compared; of two trigrams with one number the second is judged by its classes
    number = F.xxhash64(*_WORDS)
    known = asked.select(number.alias("h"), *[F.col(w).alias(f"known_{w}") for w in _WORDS], "id").dropDuplicates(["h"])
    same = (F.col("wa") == F.col("known_wa")) & (F.col("wb") == F.col("known_wb")) & (F.col("wc") == F.col("known_wc"))
    marked = each.withColumn("h", number).join(F.broadcast(known), "h", "left").select(*classes, F.when(same, F.col("id")).alias("id"))
    found = materialise(marked.groupBy("a", "b", "c", "id").agg(count), "all-trigrams")
    return found.groupBy("a", "b", "c").agg(F.sum("n").alias("n")), found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))


def _word_shares(asked: DataFrame, seen: DataFrame, min_seen: int, max_terminal_share: float) -> DataFrame:
    """(wa, wb, wc, word_share): of the final trigrams of words that tell, in which share of their places they end a text.

    One that ends in half a word is seen at ends only, so it seems to end texts often as soon as there are enough of them.
    It is known by the trigrams that go on with the word: where it was cut so often, some were cut at its end and are asked for too.
    """
    others, ended_others = F.col("n") - 1, F.col("ended") - 1
    share = ended_others / others
    counts = materialise(asked.join(bounded_broadcast(materialise(seen, "seen-words")), "id").where(others >= min_seen).select(*_WORDS, "n", "ended", share.alias("word_share")), "word-counts")
    often = counts.where((ended_others >= OFTEN_ENDED) & (F.col("word_share") >= OFTEN_SHARE))
    beginnings = F.expr("transform(sequence(1, length(wc) - 1), i -> substring(wc, 1, i))")
    longer = counts.where(F.length("wc") > 1).select("wa", "wb", F.explode(beginnings).alias("wc"), F.col("n").alias("longer"))
    goes_on = longer.join(bounded_broadcast(often.select(*_WORDS)), list(_WORDS), "left_semi").groupBy(*_WORDS).agg(F.sum("longer").alias("goes_on"))
    whole = often.join(bounded_broadcast(materialise(goes_on, "words-that-go-on")), list(_WORDS), "left").where(~_is_half(F.col("n"), F.col("ended"), F.coalesce("goes_on", F.lit(0)), max_terminal_share))
    return counts.where(F.col("word_share") <= max_terminal_share).select(*_WORDS, "word_share").unionByName(whole.where(F.col("word_share") > max_terminal_share).select(*_WORDS, "word_share"))


def _is_half(seen: Column, ended: Column, goes_on: Column, max_terminal_share: float) -> Column:
    """Whether a gram stands at ends only, and there seldom by the places where its last word goes on: then it ends in half a word, however often it is seen."""
    return (seen - ended <= HALF_WORD_SHARE * goes_on) & (ended <= max_terminal_share * goes_on)


def _gram(*words: Column | str) -> Column:
    return F.concat_ws(" ", *words)


def _beginnings(trigrams: DataFrame) -> dict[str, DataFrame]:
    """(gram, longer) for lengths 3, 2 and 1: in how many places a short word stands that begins with the gram's last word and is longer."""
    short = trigrams.where((F.length("c") < 6) & F.regexp_like("c", F.lit(r"^[\p{Ll}\p{M}']+$")) & (F.length("c") > 1))
    each = short.select("a", "b", "n", F.explode(F.expr("transform(sequence(1, length(c) - 1), i -> substring(c, 1, i))")).alias("begun"))
    counted = materialise(each.groupBy("a", "b", "begun").agg(F.sum("n").alias("n")), "beginnings")
    grams = {"3": ("a", "b", "begun"), "2": ("b", "begun"), "1": ("begun",)}
    return {length: counted.groupBy(_gram(*parts).alias("gram")).agg(F.sum("n").alias("longer")) for length, parts in grams.items()}


def cut_texts(texts: DataFrame, min_seen: int = MIN_SEEN, max_terminal_share: float = MAX_TERMINAL_SHARE) -> DataFrame:
    """(doc_id, cut, reason, terminal_share) of every judged text; ``texts`` has doc_id and text (own lines only), materialised.

    Trigrams are counted once over the whole texts, combined before they are shuffled, so a frequent one is no hot key;
    bigrams and words are added up from the trigrams. Only the last line of a text is read for its end.
    """
    everything = texts.select("doc_id", F.rtrim("text", F.lit(" \t\n\x0b\f\r")).alias("text")).where("text != ''").withColumn("key", F.xxhash64("text"))
    keys = materialise(everything.select("doc_id", "key"), "text-keys")
    firsts = materialise(keys.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "first-texts")
    # from here on a text is known by its key; one row of each text is read
    own = everything.join(bounded_broadcast(firsts), ["doc_id", "key"], "left_semi").select(F.col("key").alias("doc_id"), "text")
    marked = F.coalesce(F.regexp_like(F.substring("text", -200, 200), F.lit("(?i)" + _MISSING_REST)), F.lit(False))
    # the last three tokens stand in the last line, or in the lines before, if it has fewer
    last_line = F.substring_index("text", "\n", -1)
    tail = F.when(F.regexp_like(last_line, F.lit(r"\S\s+\S+\s+\S+\s+\S")), F.concat(F.lit("\n"), last_line)).otherwise(F.substring_index("text", "\n", -4))
    ends_of = own.select("doc_id", marked.alias("marked"), F.slice(tokens_of(tail), -3, 3).alias("t"))
    parts = [of(F.col("t")[i]).alias(name) for of, names in ((class_of, "abc"), (lambda token: token, ("wa", "wb", "wc"))) for i, name in enumerate(names)]
    lower = F.regexp_like("c", F.lit(r"^[\p{Ll}\p{M}']+$"))
    last = materialise(ends_of.select("doc_id", "marked", *parts).distinct(), "final-tokens")
    final_words = last.where(~F.col("marked")).groupBy(*_WORDS).agg(F.count(F.lit(1)).alias("ended")).where(~F.col("wc").isin(*_STOPS))
    asked_words = materialise(final_words.withColumn("id", F.monotonically_increasing_id()), "final-words")
    trigrams, seen_words = _counted(own, asked_words.select(*_WORDS, "id"))
    trigrams = materialise(trigrams, "trigrams")
    word_shares = materialise(_word_shares(asked_words, seen_words, min_seen, max_terminal_share), "word-shares")
    seen = trigrams.select(_gram("a", "b", "c").alias("gram"), F.col("n").alias("seen"))
    seen = seen.unionByName(trigrams.groupBy(_gram("b", "c").alias("gram")).agg(F.sum("n").alias("seen")))
    words = trigrams.groupBy(F.col("c").alias("word")).agg(F.sum("n").alias("n"))
    seen = seen.unionByName(words.select(F.col("word").alias("gram"), F.col("n").alias("seen")))
    # texts that end in a mark are known to be cut; their ends are no evidence of what ends a text
    plain = last.where("not marked")
    ended = plain.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    ended = materialise(ended, "final-trigrams")
    ended_words = ended.groupBy(F.col("c").alias("word")).agg(F.sum("n").alias("ended"))
    ended = ended.select(_gram("a", "b", "c").alias("gram"), F.col("n").alias("ended")).unionByName(ended.groupBy(_gram("b", "c").alias("gram")).agg(F.sum("n").alias("ended"))).unionByName(ended_words.select(F.col("word").alias("gram"), "ended"))

    # a lower-case last token may be half a word: then only the class of any word can tell
    short_words = words.where((F.length("word") < 6) & F.regexp_like("word", F.lit(r"^[\p{Ll}\p{M}]+$")))
    inside = short_words.join(ended_words, "word", "left").select("word", (F.col("n") - F.coalesce("ended", F.lit(0))).alias("n"))
    inside = materialise(inside, "short-words")
    stems = inside.where(F.col("n") >= min_seen).select("n", F.explode(F.expr("transform(sequence(1, length(word)), i -> substring(word, 1, i))")).alias("stem"), "word").where("stem != word").groupBy("stem").agg(F.max("n").alias("longer_n"))
    halves = stems.join(inside.select(F.col("word").alias("stem"), "n"), "stem", "left").where(F.coalesce("n", F.lit(0)) <= HALF_WORD_SHARE * F.col("longer_n")).select(F.col("stem").alias("c"), F.lit(True).alias("half"))
    open_end = F.when(lower, F.lit("xx")).otherwise(F.col("c"))
    # only texts that end in neither a full stop nor a mark of a missing rest are asked about, and equal ends once
    open_ends = last.where(~F.col("marked") & ~F.col("c").isin(*_STOPS))
    ends = ("a", "b", "c", "wa", "wb", "wc")
    grams = materialise(open_ends.select(*ends).distinct(), "open-ends").join(bounded_broadcast(materialise(halves, "half-words")), "c", "left").select(
        *ends,
        *[F.when(F.col("half").isNull(), g).alias(name) for name, g in (("e3", _gram("a", "b", "c")), ("e2", _gram("b", "c")), ("e1", F.col("c")))],
        _gram("a", "b", open_end).alias("o3"),
        _gram("b", open_end).alias("o2"),
        open_end.alias("o1"),
    )
    others = F.coalesce("seen", F.lit(0)) - 1
    ended_others = F.coalesce("ended", F.lit(0)) - 1
    enough = (others >= min_seen) | (ended_others >= MIN_ENDED)
    half_here = _is_half(*(F.coalesce(x, F.lit(0)) for x in ("seen", "ended")), F.coalesce("longer", F.lit(0)) + F.coalesce("long", F.lit(0)), max_terminal_share)
    judged = grams.join(bounded_broadcast(word_shares), ["wa", "wb", "wc"], "left")
    begun = _beginnings(trigrams)
    # a length at a time: the words and bigrams, which very many texts share, are few and broadcast
    for length in ("3", "2", "1"):
        levels = [f"e{length}", f"o{length}"]
        asked = grams.select(F.explode(F.array(*levels)).alias("gram")).where("gram is not null").distinct()
        known = asked.join(ended, "gram", "left").join(seen, "gram", "left").where(enough)
        known = materialise(known.select("gram", "ended", "seen", (F.greatest(ended_others, F.lit(0)) / F.greatest(others, F.lit(1))).alias("share")), "terminal-shares")
        short_ends = grams.where(lower & (F.length("c") < 6)).select(F.col(levels[0]).alias("gram"), F.col(levels[1]).alias("open")).where("gram is not null").distinct()
        often = known.where(F.col("share") > max_terminal_share).join(short_ends, "gram").join(begun[length], "gram", "left")
        often = often.join(seen.select(F.col("gram").alias("open"), F.col("seen").alias("long")), "open", "left").where(half_here)
        halves_here = bounded_broadcast(materialise(often.select("gram", F.lit(True).alias("half")), "half-words-here"))
        known = bounded_broadcast(known.select("gram", "share"))
        for level in levels:
            judged = judged.join(known.select(F.col("gram").alias(level), F.col("share").alias(f"share_{level}")), level, "left")
        judged = judged.join(halves_here.select(F.col("gram").alias(levels[0]), F.col("half").alias(f"half_{length}")), levels[0], "left")
    shares = [F.when(F.col(f"half_{x[1]}").isNull(), F.col(f"share_{x}")) if x[0] == "e" else F.col(f"share_{x}") for x in ("e3", "o3", "e2", "o2", "e1", "o1")]
    share = F.coalesce(F.when(F.col("half_3").isNull(), F.col("word_share")), *shares)
    shares = materialise(judged.select(*ends, share.alias("terminal_share")), "end-shares")
    reason = F.when(F.col("marked"), "mark").when(F.col("terminal_share") <= max_terminal_share, "gram")
    verdicts = last.join(bounded_broadcast(shares), list(ends), "left").select(F.col("doc_id").alias("key"), reason.isNotNull().alias("cut"), reason.alias("reason"), "terminal_share")
    return keys.join(verdicts, "key").select("doc_id", "cut", "reason", "terminal_share")


def cut_report(flags: DataFrame, articles: DataFrame) -> DataFrame:
    """(source, n_articles, n_cut, cut_share): how often each source cuts its texts, of its judged articles."""
    rows = articles.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(flags.select("doc_id", "cut"), "doc_id")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_articles"), F.sum(F.col("cut").cast("long")).alias("n_cut"))
    return counts.withColumn("cut_share", F.col("n_cut") / F.col("n_articles"))
