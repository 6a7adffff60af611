"""Problem 9: figures per document that tell running prose from lists, tables and junk.

Method: word, symbol and line statistics, repetition statistics (duplicate lines and paragraphs, the share of
the text that its dominant n-gram covers) and combined rules over them.

The figures are taken over the body, the text after its first line. A null, empty or one-line text has an empty
body; its figures are 0 and its kind is ``empty``. Nothing depends on other documents or on the language tag.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that hold sentences together, a paragraph each of English, German, French, Spanish, Italian, Portuguese,
# Dutch, Polish, Czech, Swedish, Danish and Norwegian, Turkish, Indonesian, Finnish, Russian, Ukrainian and Greek.
COMMON_WORDS = frozenset(
    """a about above after again all also am among an and another any are as at be because been before being between both but by can could did do does down each earlier even every for from
    had has have having he her here him his how i if in into is it its itself just last least less like many may me might more most much must my neither never new no nor not now of off on
    once one only or other our out over own per said same say says she should since so some still such than that the their them then there these they this those through to too under until up
    very was we were what when where whether which while who whom why will with within without would year years yet you your
    aber als am an auch auf aus bei bis da damit dann das dass dem den denn der des die dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er es für gegen habe haben
    hat hatte ich ihr ihre im in ist ja jahr jahre jahren jetzt kann kein keine man mehr mit muss nach nicht noch nur ob oder ohne sagte schon sein seine seit sich sie sind so soll über um und uns unter
    vom von vor war waren was weil wenn werden wie wir wird wo wurde wurden zu zum zur zwischen
    au aux avec avons ce ces cette comme dans de depuis des deux dit donc du elle en encore est et être eu fait il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour
    qu que qui sa sans se sera ses si son sont sous sur tous tout tu un une vous voulait était été
    al algo años antes aunque bien cada como con contra cuando de del desde donde dos el ella ellos en entre era es esa ese eso esta está este esto fue ha había han hasta hay la las le lo los más
    me mi muy nada ni no nos o otra otro para pero poco por porque que qué quien quiere se según ser si sin sobre son su sus también tan tiene todo todos un una uno ya
    a ai al alla alle allo anche ancora c che chi ci come con cui d da dai dal dall dalla dalle degli dei del dell della delle dello di dopo dove due e è ed era erano fra gli ha hanno i il in io
    l la le lei loro lui lo ma mentre mi nei nel nell nella nelle noi non nulla o ogni per perché più poi prima quando quella quelle quello questa questo qui sarà se senza si sia sono sotto stata
    stato su sua sui sul sull sulla suo suoi tra tutti tutto un una uno verso
    à ainda ao aos as até com como da das de dela dele depois do dos e é ela elas ele eles em enquanto entre era essa esse esta estava este eu foi foram há isso já lhe mais mas me mesmo muito na nas
    não nem no nos o os ou para pela pelas pelo pelos por porque quando que quem se sem ser seu seus só sob sobre sua suas também tem ter tinha um uma uns
    aan al als ander bij dan dat de deze die dit doch door dus een en er ge geen geweest haar had heb hebben heeft hem het hier hij hoe hun ik in is ja je kan kon kunnen maar me meer men met mij mijn
    na naar niet nog nu of om omdat onder ons ook op over te tegen toch toen tot u uit uw van veel voor want waren was wat we werd wezen wie wij wil worden wordt zal ze zei zelf zich zij zijn zo zonder zou
    a aby ale bez bo być był była było były bym ci co czy dla do gdy gdzie go i ich im ja jak jako je jego jej jest jeszcze jeśli już każdy kiedy kto która które który ku lub ma mam mi mnie może my na nad
    nas nawet nie nich nim niż o od on ona one oni oraz po pod przed przez przy są się ta tak także tam te tego tej ten też to tu tylko tym w we więc wszystko z za że ze
    a aby ale ani až bez bude by byl byla bylo byly být co či do i ja jak jako je jeho její jejich jen ještě již k kde kdo když která které který ma mezi mu na nad ne nebo není než o od on ona po pod podle pro
    před přes při s se si své tak také ten to tu u už v ve však z za ze že
    alla allt att av bara blev bli blir de dem den denna deras dess det detta dig din då där efter ej eller en er ett från för ha hade han har hennes hon hur här i icke inom inte jag kan kunde man med mellan men
    mig min mot mycket ni nu när någon något några och om oss på sedan sig sin sina sitt skulle som så till under upp ut utan vad var vara varit vi vid är över
    ad af at blev blive bliver da de dem den denne der deres det dette dig din du efter ej eller en er et for fra få ham han hans har havde hende her hun hvad hvis hvor i ikke ind jeg jer jo kan kunne man mange
    med meget men mig min mod ned noget nogle nu når og også om op os over på selv sig sin skal skulle som til ud under var vi vil ville vor være været å ble blitt både fordi hvem ingen noe noen
    ama ancak bir biz bu bütün çok da daha de değil diye en gibi hem her hiç için ile ise kadar ki kim mı mi mu nasıl ne neden o olan olarak oldu olduğu on onu onun sonra şu ve veya ya yani yok var
    ada adalah agar akan aku anda atau bagi bahwa banyak bisa dalam dan dapat dari dengan di dia harus hingga ia ini itu jika juga kami karena ke kepada lebih mereka oleh pada para saat saja sebagai seorang
    sudah tahun telah tidak untuk yang
    ei eivät he hän hänen ja jo joka jos jossa kanssa kuin kun me mitä mukaan mutta myös ne niin nyt ole oli olivat olla on ovat se sen sekä siitä sitä että tai te tämä vain vaikka voi
    а без был была были было быть в вам вас весь во вот все всё вы где да даже для до его ее её если есть еще ещё же за и из или им их к как ко когда кто ли мне мы на над нас не него нет ни но о об он она они
    от очень по под после при с сам со так также там тем то того тоже только том ты у уже чем что чтобы эта эти это этого этот я
    або але б бо був була були було в вже від він вона вони все він до є ж за з зі і й із їх його її як яка який які коли ми на не ні о по при про та так також те того то у це цей чи що щоб я
    αλλά αν από αυτή αυτό για δε δεν είναι εκείνη ένα ένας έχει η ήταν θα και κατά με μετά μη μια να ο οι όπως ότι που προς σε στη στην στο στον τα τη την της τι το τον του τους των ως""".split()
)
# Characters that hold sentences together in scripts without spaces (Japanese, Chinese, Thai), and the marks that end them.
COMMON_CHARACTERS = frozenset("のはをにがとでもたるいしてなられさすっだか的了是在和不有我他这這一人就为為也要与與及等说說们們上中大来來到會会ที่การและเป็นในของไม่ได้มาให้ก็ว่า")
_FULL_STOPS = "。！？．｡"
_DENSE_SCRIPT = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN_TOKEN = re.compile(r"""^[("'“‘«„\[¿¡—–-]*[^\W\d_]+(?:[-'’/][^\W\d_]+)*[)"'”’»“\].,;:!?…]*$""")
_NUMBER_TOKEN = re.compile(r"^[+\-−~±$€£(]?\d[\d.,:/%-]*[)%.,;:]?$|^[-–—]$")
_BULLET = re.compile(r"^\s*(?:[-*•·–—▪◦‣+]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\[[ x]\])\s+")
_CLOCK = re.compile(r"^\s*\d{1,2}[:.]\d{2}\b")
# what may follow the mark that ends a sentence
_CLOSING = "\"'”’»)]"
_SENTENCES = re.compile(r"""[.!?…]["'”’»)\]]*(?:\s|$)|[。！？．｡]""")

FIGURES = (
    ("n_chars", "long"),
    ("n_words", "long"),
    ("n_lines", "long"),
    ("mean_word_length", "double"),
    ("symbol_ratio", "double"),
    ("digit_ratio", "double"),
    ("plain_token_share", "double"),
    ("number_token_share", "double"),
    ("common_word_share", "double"),
    ("distinct_word_share", "double"),
    ("line_end_share", "double"),
    ("bullet_line_share", "double"),
    ("words_per_line", "double"),
    ("words_per_sentence", "double"),
    ("duplicate_line_share", "double"),
    ("duplicate_paragraph_share", "double"),
    ("dominant_ngram_share", "double"),
    ("prose_line_share", "double"),
    ("separator_share", "double"),
    ("n_tokens", "long"),
    ("continued_line_share", "double"),
    ("short_word_share", "double"),
    ("capital_share", "double"),
    ("dense_script_share", "double"),
    ("common_character_share", "double"),
)


def body_of(text: str | None) -> str:
    """The text after its first line."""
    return text.split("\n", 1)[1] if text and "\n" in text else ""


def _duplicate_share(parts: list[str]) -> float:
    """Share of characters that stand in parts seen before."""
    total = sum(map(len, parts))
    counts = Counter(parts)
    return sum(len(p) * (n - 1) for p, n in counts.items() if n > 1) / total if total else 0.0


def _dominant_share(words: list[str], sizes: tuple[int, ...] = (3, 4, 6, 9, 13)) -> float:
    """Largest share of the words' characters that one n-gram of 2, 3, 4, 6, 9 or 13 words, said more than once, covers.

    Of all repeated n-grams of a length that counts which covers most, whether it is long or said often. A longer n-gram is
    said twice only where its first words are, so only those places are counted again.
    """
    if len(words) < 4:
        return 0.0
    total = sum(map(len, words))
    grams = list(zip(words, words[1:]))
    counts = Counter(grams)
    best = 0
    places = [i for i, gram in enumerate(grams) if counts[gram] > 1]
    for n in (2, *sizes):
        if n > 2:
            grams = {i: tuple(words[i : i + n]) for i in places if i + n <= len(words)}
            counts = Counter(grams.values())
            places = [i for i, gram in grams.items() if counts[gram] > 1]
        if not places or len(words) < 2 * n:
            break
        best = max(best, max(sum(map(len, gram)) * k for gram, k in counts.items() if k > 1))
    return min(1.0, best / total)


def _elided(words: list[str]) -> int:
    """How many words are joined to a short common one by an apostrophe, as in "l'uomo"."""
    return sum(w.replace("’", "'").split("'", 1)[0] in COMMON_WORDS for w in words if ("'" in w or "’" in w) and w not in COMMON_WORDS)


@lru_cache(maxsize=200_000)
def _is_plain(token: str) -> bool:
    """A word with nothing but punctuation around it."""
    return _PLAIN_TOKEN.match(token) is not None


@lru_cache(maxsize=100_000)
def _is_number(token: str) -> bool:
    return _NUMBER_TOKEN.match(token) is not None


_ASCII = bytes(range(128))
_ASCII_LETTERS = bytes(i for i in range(128) if chr(i).isalpha())
_ASCII_DIGITS = b"0123456789"


def _letters_and_digits(body: str) -> tuple[int, int]:
    """How many letters and digits a text has; character by character only beyond ASCII."""
    coded = body.encode("utf-8", "surrogatepass")
    letters = len(coded) - len(coded.translate(None, _ASCII_LETTERS))
    digits = len(coded) - len(coded.translate(None, _ASCII_DIGITS))
    wide = coded.translate(None, _ASCII).decode("utf-8", "surrogatepass")
    return letters + sum(map(str.isalpha, wide)), digits + sum(map(str.isdigit, wide))


def figures(text: str | None) -> dict[str, float]:
    """The figures of one text's body."""
    body = body_of(text)
    tokens = body.split()
    out: dict[str, float] = dict.fromkeys((name for name, _ in FIGURES), 0)
    if not tokens:
        return out
    lines = [line for line in map(str.strip, body.split("\n")) if line]
    dense = sum(map(len, tokens))
    plain = sum(map(_is_plain, tokens))
    numbers = sum(map(_is_number, tokens)) if plain < len(tokens) else 0
    letters, digits = _letters_and_digits(body)
    words: list[str] = []
    common = prose = ended = bullets = continued = 0
    elisions = "'" in body or "’" in body
    dense_script = sum(map(len, _DENSE_SCRIPT.findall(body))) if letters and letters > 5 * len(tokens) and not body.isascii() else 0
    by_character = dense_script >= 0.5 * letters > 0
    for line in lines:
        mine = _WORD.findall(line.lower())
        words += mine
        held = sum(map(COMMON_WORDS.__contains__, mine)) + (_elided(mine) if elisions else 0)
        common += held
        end = line.rstrip(_CLOSING).endswith((".", "!", "?", "…", *_FULL_STOPS))
        bullet = _BULLET.match(line) is not None
        ended += end
        continued += not bullet and line[0].islower()
        bullets += bullet or _CLOCK.match(line) is not None
        # a line of a sentence is held together by common words, and is no item unless it ends as a sentence
        if len(mine) >= 2 and held >= 0.25 * len(mine) and (end or not bullet):
            prose += len(line)
    lengths = Counter(map(len, words))
    out.update(
        n_chars=len(body),
        n_words=len(words),
        n_lines=len(lines),
        mean_word_length=sum(n * k for n, k in lengths.items()) / len(words) if words else 0.0,
        symbol_ratio=(dense - letters - digits) / dense,
        digit_ratio=digits / dense,
        plain_token_share=plain / len(tokens),
        number_token_share=numbers / len(tokens),
        common_word_share=common / len(words) if words else 0.0,
        distinct_word_share=len(set(words)) / len(words) if words else 0.0,
        line_end_share=ended / len(lines),
        bullet_line_share=bullets / len(lines),
        words_per_line=len(words) / len(lines),
        words_per_sentence=len(words) / max(1, len(_SENTENCES.findall(body))),
        duplicate_line_share=_duplicate_share(lines),
        duplicate_paragraph_share=_duplicate_share([p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]),
        dominant_ngram_share=_dominant_share(_DENSE_SCRIPT.findall(body) if by_character else words),
        prose_line_share=prose / sum(map(len, lines)),
        separator_share=sum(body.count(c) for c in ",;|\t=") / len(tokens),
        n_tokens=len(tokens),
        continued_line_share=continued / len(lines),
        short_word_share=(lengths[1] + lengths[2] + lengths[3]) / len(words) if words else 0.0,
        capital_share=sum(map(str.istitle, tokens)) / len(tokens),
        dense_script_share=dense_script / letters if letters else 0.0,
        common_character_share=sum(map(COMMON_CHARACTERS.__contains__, body)) / dense_script if dense_script else 0.0,
    )
    return out


def kind_of(f: dict[str, float]) -> str:
    """``prose``, ``list``, ``table``, ``junk`` or ``empty``, by combined rules over the figures."""
    if not f["n_tokens"]:
        return "empty"
    repetitive = f["dominant_ngram_share"] >= 0.35 or f["duplicate_line_share"] >= 0.4
    if f["dense_script_share"] >= 0.5:
        # words aren't parted by spaces: the characters that hold sentences together, and no row of short items
        if not repetitive and f["common_character_share"] >= 0.15 and f["bullet_line_share"] < 0.5 and f["digit_ratio"] < 0.2:
            return "prose"
        return "table" if f["number_token_share"] >= 0.17 else "list" if not repetitive and f["n_lines"] >= 3 else "junk"
    worded = f["plain_token_share"] >= 0.6 and f["mean_word_length"] >= 2.2
    if worded and not repetitive:
        held_together = f["common_word_share"] >= 0.42 or (f["common_word_share"] >= 0.3 and f["line_end_share"] >= 0.3)
        if held_together and f["prose_line_share"] >= 0.5:
            return "prose"
        # sentences broken into lines: most go on in the next line, and words hold them together
        broken = f["continued_line_share"] >= 0.5 and f["words_per_line"] >= 3
        if broken and f["common_word_share"] >= 0.25 and f["bullet_line_share"] < 0.2 and f["separator_share"] < 0.2:
            return "prose"
        # a language without a word list here: whole sentences of usual length, not broken into items
        if f["line_end_share"] >= 0.6 and f["plain_token_share"] >= 0.8 and 4 <= f["words_per_sentence"] <= 45 and f["bullet_line_share"] < 0.5:
            return "prose"
        # or long lines of words in small letters, short ones among them, hardly parted by commas
        if f["words_per_line"] >= 12 and f["short_word_share"] >= 0.2 and f["plain_token_share"] >= 0.9 and f["capital_share"] < 0.35 and f["separator_share"] < 0.12 and f["mean_word_length"] <= 9:
            return "prose"
    if f["number_token_share"] >= 0.17 and f["n_lines"] >= 3 and f["bullet_line_share"] < 0.5:
        return "table"
    if worded and not repetitive and (f["n_lines"] >= 3 or f["separator_share"] >= 0.2):
        return "list"
    return "table" if f["digit_ratio"] >= 0.09 and f["separator_share"] >= 0.4 and f["n_lines"] >= 3 and f["symbol_ratio"] < 0.38 else "junk"


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, figures...): one row per document."""
    names = [name for name, _ in FIGURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if kind == "long" else pa.float64() for _, kind in FIGURES]
        for batch in batches:
            rows = [figures(text) for text in batch.column(1).to_pylist()]
            kinds = pa.array([kind_of(row) for row in rows], pa.string())
            columns = [pa.array([row[name] for row in rows], t) for name, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds, *columns], names=["doc_id", "kind", *names])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, " + ", ".join(f"{n} {k}" for n, k in FIGURES))


def agreement(kinds: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, kind, held_out, n): how the rules agree with labelled documents.

    The thresholds were set on the labelled documents of even doc_id; those of odd doc_id are held out. Null labels and
    documents that aren't there don't count, repeated labels count once.
    """
    rows = labels.where("label is not null").select("doc_id", "label").distinct().join(kinds.select("doc_id", "kind"), "doc_id")
    return rows.groupBy("label", "kind", (F.col("doc_id") % 2 != 0).alias("held_out")).agg(F.count(F.lit(1)).alias("n"))
