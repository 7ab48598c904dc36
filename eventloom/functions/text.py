"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_CN = "[一-鿿]"
_LATIN = "[\\w&&[^一-鿿]]"
#: ASCII punctuation, for character classes.
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_SENTENCE_END = "[!?;。！？；]"
#: What (?U)\s matches.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _lines(text: Column, each) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), each), "\n")


def normalize_text(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Texts that are Python strings at once, of a batch.
_AT_ONCE = 64


def nfkc(texts: pa.Array) -> pa.Array:
    """Texts in NFKC. A few of a batch are Python strings at a time, so memory is that of the batch and its result."""
    parts = [pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in texts.slice(at, _AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize_for_embedding(text: Column) -> Column:
    """NFKC, lower case, white space collapsed; empty for null. NFKC has no built-in form and runs over Arrow batches."""
    run = F.arrow_udf(lambda s: nfkc(s), "string")
    return normalize_text(F.lower(run(F.coalesce(text, F.lit("")))))


def normalize_entity_name(name: Column) -> Column:
    """Lower case without punctuation, spaces collapsed last."""
    return normalize_text(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""))


def normalize_entity_name_keep_gaps(name: Column) -> Column:
    """Lower case, spaces collapsed first; punctuation that stood alone then leaves two spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def name_key(name: Column) -> Column:
    """Lower case without spaces, ideographic ones included: the key of exact name matches."""
    return F.translate(F.lower(name), " 　", "")


def markdown_headings(text: Column) -> Column:
    """'## title' of each heading line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    return F.transform(lines, lambda x: F.concat(F.regexp_extract(x, r"^(#{1,6})\s+(.+)$", 1), F.lit(" "), F.regexp_extract(x, r"^(#{1,6})\s+(.+)$", 2)))


def document_title(text: Column) -> Column:
    """The first heading of level 1 to 6, 'Untitled' without one or for null."""
    found = F.trim(F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1))
    return F.coalesce(F.when(found != "", found), F.lit("Untitled"))


# Fixed value: the namespace of DNS names for UUIDs of version 5.
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The UUID of version 5 of a name among DNS names; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def text_hash(text: Column) -> Column:
    return F.md5(text)


def truncate(text: Column, most: int = 100, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def count_chinese(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_CN))


def estimate_tokens(text: Column) -> Column:
    cn = count_chinese(text)
    return F.floor(cn / 1.5 + (F.length(text) - cn) / 4)


def truncate_to_tokens(text: Column, most: int) -> Column:
    """Text of more than so many estimated tokens is cut in proportion, less a tenth to be safe."""
    n = estimate_tokens(text)
    keep = F.floor(F.length(text) * F.try_divide(F.lit(most), n) * 0.9).cast("int")
    return F.when(n <= most, text).otherwise(F.substring(text, F.lit(1), keep))


# Factors of Chinese characters and Latin words for each family of models.
TOKEN_FACTORS = {"generic": (0.8, 1.0), "gpt": (0.7, 1.0), "claude": (0.65, 1.1), "llama": (0.8, 1.3)}


def chunk_tokens(text: Column, model: str = "generic") -> Column:
    """Conservative estimate: Chinese characters, Latin words and half of the other signs; one at least, none for no text."""
    cn, latin = TOKEN_FACTORS[model]
    words = F.regexp_count(text, F.lit(r"(?U)\b[a-zA-Z]+\b"))
    signs = F.regexp_count(text, F.lit(r"(?U)[^\w\s]"))
    total = F.floor(count_chinese(text) * cn) + F.floor(words * latin) + F.floor(signs * 0.5)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), total))


def clean_whitespace(text: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n{3,}", "\n\n")
    return _lines(squeezed, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def sentences(text: Column, least: int = 5) -> Column:
    parts = F.transform(F.split(text, f"{_SENTENCE_END}+"), lambda x: F.btrim(x, F.lit(_SPACES)))
    return F.filter(parts, lambda x: F.length(x) >= least)


def sentences_with_ends(text: Column, least: int = 5) -> Column:
    """(sentence, mark) of each sentence; mark is empty for a last one that has none."""
    parts = F.regexp_extract_all(text, F.lit(f"([^!?;。！？；]*)({_SENTENCE_END}+|$)"), F.lit(0))
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_replace(F.regexp_replace(x, f"{_SENTENCE_END}+$", ""), r"(?U)^\s+|\s+$", "").alias("sentence"), F.regexp_extract(x, f"{_SENTENCE_END}+$", 0).alias("mark")))
    return F.filter(pairs, lambda p: F.length(p["sentence"]) >= least)


def split_keeping(text: Column, marks: str = "。！？；.!?;\\n") -> Column:
    """Parts that end with their delimiter."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"[^{marks}]*[{marks}]|[^{marks}]+"), F.lit(0)), lambda x: F.length(x) > 0)


def word_count(text: Column) -> Column:
    """Chinese characters plus the white-space words beyond them."""
    cn = count_chinese(text)
    return cn + F.greatest(F.lit(0), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")) - cn)


def detect_language(text: Column) -> Column:
    cn, en = count_chinese(text), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(cn * 10 > (cn + en) * 3, "chinese").otherwise("english")


def normalize_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), f"[{PUNCTUATION}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def purify(text: Column) -> Column:
    """Lower case without ASCII punctuation and white space: the key of chunk dedup."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[{PUNCTUATION}]", ""), r"(?U)\s+", "")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def tokens(text: Column) -> Column:
    """Lower-case words: runs of Latin letters and digits, single Chinese characters where no segmenter is at hand."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{_CN}|(?U){_LATIN}+"), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"{_CN}|(?U){_LATIN}+"))


def count_token(text: Column, term: str) -> Column:
    """How many of the text's tokens are the lower-case term, without an array of all tokens."""
    if re.fullmatch(_CN, term):
        return F.regexp_count(F.lower(text), F.lit(term))
    if not re.fullmatch(r"\w+", term) or re.search(_CN, term):
        return F.lit(0)
    return F.regexp_count(F.lower(text), F.lit(rf"(?U)(?<!{_LATIN}){term}(?!{_LATIN})"))


# Words that are no keywords, Chinese and English.
CHINESE_STOPWORDS = (
    "我 你 他 她 它 我们 你们 他们 自己 什么 哪 哪里 的 地 得 了 着 过 啊 呢 吧 啦 呀 和 与 及 或 而 但 但是 然而 虽然 因为 所以 如果 "
    "在 从 向 到 对 于 为 以 把 被 让 给 很 非常 太 更 最 都 也 就 才 只 还 又 再 是 有 做 去 来 说 要 会 能 可以 应该 需要 "
    "一 二 三 个 些 点 这 那 这个 那个 这些 那些 等 等等 就是 可能 已经 正在 没有 不 没"
).split()
ENGLISH_STOPWORDS = (
    "a an the i you he she it we they me him her us them my your his its our their this that these those who whom what which whose "
    "where when why how in on at to for of with by from into through during before after above below between under about and but or "
    "nor so yet both either neither if then is are was were be been being have has had do does did will would could should may might "
    "must can not no only just also very too more most than as such some any all each every other another"
).split()
STOPWORDS = (*CHINESE_STOPWORDS, *ENGLISH_STOPWORDS)


def keywords(text: Column, top: int = 20, least: int = 3, stopwords: Sequence[str] = ()) -> Column:
    """The fallback extraction: capitalised or plain words of some length but stopwords, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"\b[A-Za-z][A-Za-z0-9\-]{{{least - 1},}}\b"), F.lit(0))
    words = F.array_distinct(F.transform(found, F.lower))
    return F.slice(F.array_except(words, F.array(*[F.lit(w.lower()) for w in sorted(stopwords)])) if stopwords else words, 1, top)


# Words of advertisements, and signs of contacts.
ADVERTISEMENT = "扫码|加群|优惠券|点击领取|限时免费"
CONTACT = r"(?U)(微信|QQ)[:：]?\s*\w+"


def low_quality(title: Column, content: Column, n_entities: Column) -> Column:
    """(bad, reason): empty, only links, two signs of advertisement, control characters."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    signs = (
        c.rlike(ADVERTISEMENT).cast("int")
        + c.rlike(CONTACT).cast("int")
        + ((F.coalesce(n_entities, F.lit(0)) == 0) & (F.length(c) < 20)).cast("int")
    )
    reason = (
        F.when((c == "") | (t == ""), "empty")
        .when(F.length(F.trim(F.regexp_replace(c, r"https?://\S+", ""))) < 5, "only links")
        .when(signs >= 2, "advertisement")
        .when(c.rlike(r"[\x00-\x1f\x7f-\x9f]{3,}"), "control characters")
    )
    return F.struct(reason.isNotNull().alias("bad"), reason.alias("reason"))


# Estimated tokens up to which a text is taken as it is, and then most sentences by tokens.
WHOLE_TOKENS, SUMMARY_SIZES = 5000, ((50000, 150), (400000, 350), (None, 500))


def sentence_budget(n_tokens: Column, n_sentences: Column, ratio: float = 0.3) -> Column:
    """Sentences that a summary takes; 0: the text as it is."""
    want = F.greatest(F.lit(1), F.floor(n_sentences * ratio))
    out = F.when(n_tokens <= WHOLE_TOKENS, 0)
    for tokens, most in SUMMARY_SIZES:
        out = out.otherwise(F.least(F.lit(most), want)) if tokens is None else out.when(n_tokens <= tokens, F.least(F.lit(most), want))
    return out


def summary_sentences(n_tokens: int, n_sentences: int, ratio: float = 0.3) -> int:
    """sentence_budget of plain numbers."""
    if n_tokens <= WHOLE_TOKENS:
        return 0
    most = next(m for tokens, m in SUMMARY_SIZES if tokens is None or n_tokens <= tokens)
    return min(most, max(1, int(n_sentences * ratio)))


def count_occurrences(text: Column, name: Column, lower: bool = False, least: int = 0) -> Column:
    """Times that name occurs in text, not overlapping; least where it does not, or is empty."""
    t, n = (F.lower(text), F.lower(name)) if lower else (text, name)
    times = ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.greatest(F.length(n), F.lit(1))).cast("int")
    return F.greatest(F.lit(least), F.when(F.length(n) > 0, times).otherwise(0))


def word_overlap(gold: Column, found: Column) -> Column:
    """Share of the distinct gold words that are found."""
    split = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    g = split(gold)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(g, split(found))), F.size(g)), F.lit(0.0))


def embedding_text(title: Column, content: Column, most: int) -> Column:
    return F.concat_ws("\n\n", title, F.substring(content, 1, most))
