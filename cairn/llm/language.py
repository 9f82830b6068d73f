"""Languages of documents and of the stretches inside them.

Each language has a codeword of ``BITS`` bits whose pairwise distances are large. One binary
classifier over hashed letter n-grams predicts each bit; decoding adds up each bit's loss,
weighted by how well that bit does on sentences not trained on, and takes the codeword with
the least loss. A near runner-up makes a sentence ambiguous; it then follows its neighbours.

Prose is found first: code, logs, paths, identifiers, numbers and quoted messages are blanked.
Letters are folded (case, marks, damaged encodings) alike for training and use, so that a
language stays the same however it is written.

The classifier is fitted on a bounded sample of labelled rows (``per_language`` documents a
label, training only); every document is then read whole.
"""

from __future__ import annotations

import collections
import functools
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fold_key
from ..session import spread
from .bpe import text_slices

#: Bits of a codeword, size of the hashed feature space (a power of two), longest n-gram.
BITS, FEATURES, NGRAM = 31, 1 << 15, 4
#: How often a document of one or two sentences is taken into the training, since remarks are few and short.
SHORT_WEIGHT = 4
#: Tokens summed up at once, and entries of a worker's memo of tokens.
STEP, MEMO = 50_000, 200_000
#: Gap of confidence below which a sentence is ambiguous.
AMBIGUOUS = 0.35

#: ISO 639 codes of each language, the two-letter one first, and its English names.
_LABELS = """
aa aar: afar|ab abk: abkhazian, abkhaz|ae ave: avestan|af afr: afrikaans|ak aka fat: akan|tw twi: twi|am amh: amharic|an arg: aragonese|ar ara arb arz apc: arabic
as asm: assamese|av ava: avaric, avar|ay aym ayr: aymara|az aze azj azb: azerbaijani, azeri|ba bak: bashkir|be bel: belarusian, belarussian|bg bul: bulgarian|bh bih: bihari
bi bis: bislama|bm bam: bambara|bn ben: bengali, bangla|bo bod tib: tibetan|br bre: breton|bs bos: bosnian|ca cat: catalan, valencian|ce che: chechen|ch cha: chamorro
co cos: corsican|cr cre: cree|cs ces cze: czech|cu chu: church slavic, church slavonic, old church slavonic|cv chv: chuvash|cy cym wel: welsh|da dan: danish|de deu ger: german
dv div: divehi, dhivehi, maldivian|dz dzo: dzongkha|ee ewe: ewe|el ell gre: greek, modern greek|en eng: english|eo epo: esperanto|es spa: spanish, castilian|et est ekk: estonian
eu eus baq: basque|fa fas per pes prs: persian, farsi, dari|ff ful: fulah, fula|fi fin: finnish|fj fij: fijian|fo fao: faroese|fr fra fre: french|fy fry: western frisian, frisian
ga gle: irish|gd gla: scottish gaelic, gaelic|gl glg: galician|gn grn gug: guarani|gu guj: gujarati|gv glv: manx|ha hau: hausa|he heb iw: hebrew|hi hin: hindi|ho hmo: hiri motu
hr hrv scr: croatian|ht hat: haitian, haitian creole|hu hun: hungarian|hy hye arm: armenian|hz her: herero|ia ina: interlingua|id ind in: indonesian|ie ile: interlingue, occidental
ig ibo: igbo|ii iii: sichuan yi, nuosu|ik ipk: inupiaq|io ido: ido|is isl ice: icelandic|it ita: italian|iu iku: inuktitut|ja jpn: japanese|jv jav jw: javanese|ka kat geo: georgian
kg kon: kongo|ki kik: kikuyu, gikuyu|kj kua: kuanyama, kwanyama|kk kaz: kazakh|kl kal: kalaallisut, greenlandic|km khm: khmer, central khmer|kn kan: kannada|ko kor: korean
kr kau: kanuri|ks kas: kashmiri|ku kur kmr: kurdish|kv kom: komi|kw cor: cornish|ky kir: kirghiz, kyrgyz|la lat: latin|lb ltz: luxembourgish|lg lug: ganda, luganda
li lim: limburgan, limburgish|ln lin: lingala|lo lao: lao|lt lit: lithuanian|lu lub: luba-katanga|lv lav lvs: latvian|mg mlg plt: malagasy|mh mah: marshallese|mi mri mao: maori
mk mkd mac: macedonian|ml mal: malayalam|mn mon khk: mongolian|mr mar: marathi|ms msa may zsm zlm: malay|mt mlt: maltese|my mya bur: burmese|na nau: nauru|nd nde: north ndebele
ne nep npi: nepali|ng ndo: ndonga|nl nld dut: dutch, flemish|no nor nob nno nb nn: norwegian, norwegian bokmal, norwegian nynorsk, bokmal, nynorsk|nr nbl: south ndebele
nv nav: navajo, navaho|ny nya: chichewa, nyanja|oc oci: occitan|oj oji: ojibwa|om orm gaz: oromo|or ori ory: oriya, odia|os oss: ossetian, ossetic|pa pan: punjabi, panjabi
pi pli: pali|pl pol: polish|ps pus pbu: pashto, pushto|pt por: portuguese|qu que: quechua|rm roh: romansh|rn run: rundi|ro ron rum mo mol: romanian, moldavian|ru rus: russian
rw kin: kinyarwanda|sa san: sanskrit|sc srd: sardinian|sd snd: sindhi|se sme: northern sami|sg sag: sango|si sin: sinhala, sinhalese|sk slk slo: slovak|sl slv: slovenian, slovene
sm smo: samoan|sn sna: shona|so som: somali|sq sqi alb als: albanian|sr srp scc: serbian|ss ssw: swati|st sot: southern sotho, sesotho|su sun: sundanese|sv swe: swedish
sw swa swh: swahili|ta tam: tamil|te tel: telugu|tg tgk: tajik|th tha: thai|ti tir: tigrinya|tk tuk: turkmen|tl tgl fil: tagalog, filipino|tn tsn: tswana
to ton: tonga, tongan|tr tur: turkish|ts tso: tsonga|tt tat: tatar|ty tah: tahitian|ug uig: uighur, uyghur|uk ukr: ukrainian|ur urd: urdu|uz uzb uzn: uzbek|ve ven: venda
vi vie: vietnamese|vo vol: volapuk|wa wln: walloon|wo wol: wolof|xh xho: xhosa|yi yid ydd ji: yiddish|yo yor: yoruba|za zha: zhuang|zh zho chi cmn yue: chinese, mandarin|zu zul: zulu
"""
_ENTRIES = [(codes.split(), names.split(",")) for codes, _, names in (entry.partition(":") for entry in _LABELS.strip().replace("\n", "|").split("|"))]
NAMES = {name.strip(): codes[0] for codes, names in _ENTRIES for name in (*codes, *names)}
#: What separates a language from its region, script or remark.
_REGION = r"[-_(.@]"


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, or None: a code with or without region, or a name."""
    if not label:
        return None
    low = label.strip().lower()
    return NAMES.get(low) or NAMES.get(re.split(_REGION, low)[0].strip())


#: What may open a stretch that is no prose: fences, code, tags and quotations; and what closes it.
_OPEN = re.compile("```|~~~|`|<(?=[A-Za-z/!?|])|\"|\u201c|\u201e|\u00ab|\u300c")
_CLOSE = {"`": "`", "<": ">", '"': '"', "\u201c": "\u201d", "\u201e": "\u201c\u201d", "\u00ab": "\u00bb", "\u300c": "\u300d"}
_FENCE_END = {f: re.compile(rf"^[ \t>]*+{f}[ \t]*$", re.M) for f in ("```", "~~~")}
#: Lines of logs and traces, and (as ``kind``) the kind that opens a commit message.
_LINE = re.compile(r"[ \t]*+(?:\[?+(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d:\d\d|at\s++\S+?\(|File\s|Traceback|[\[{}\]]|(?P<kind>[a-z]{2,}+(?:\([^()]*+\))?+!?+:(?=[ \t])))")
#: A run without quotes, ticks and opening angles is code if it holds a path, a name with _, members, calls, camel case or digits.
_RUN = re.compile(r"[!#-;=-_a-~]+")
_CODE = re.compile(r"[/\\_@=]|\w\.[A-Za-z_]|\w\(\)|[a-z][A-Z]|\d")


def _unquoted(text: str) -> str:
    """``text`` with spaces for fenced blocks, code, tags and quotations.

    A quotation, a tag or a span of code lies in one line and ends at its mark, however long; a
    mark without its counterpart in the line opens nothing. Linear in the text.
    """
    out, done, pos, eol = [], 0, 0, -1
    missing = dict.fromkeys(_CLOSE, -1)  # up to where a closing mark is known to be missing
    while m := _OPEN.search(text, pos):
        a, mark = m.start(), m[0]
        if mark in _FENCE_END:
            line = text.rfind("\n", pos, a) + 1 or pos
            first = (line > pos or pos == 0 or text[pos - 1] == "\n") and not text[line:a].strip(" \t>")
            if first:
                end = _FENCE_END[mark].search(text, m.end())
                b = end.end() if end else len(text)
            else:
                b = text.find(mark, m.end()) + 3
                b = b if b > 2 else len(text)
        else:
            if a >= eol:
                eol = text.find("\n", a)
                eol = eol if eol >= 0 else len(text)
            b = 0
            if missing[mark] < a:
                found = [x for x in (text.find(c, a + 1, eol) for c in _CLOSE[mark]) if x >= 0]
                if not found:
                    missing[mark] = eol
                elif min(found) > a + 1 and not (mark == "<" and text.find("<", a + 1, min(found)) >= 0):
                    b = min(found) + 1
        if b:
            out += [text[done:a], " " * (b - a)]
            done = pos = b
        else:
            pos = a + 1
    return "".join([*out, text[done:]]) if out else text


_SPLIT = re.compile(r"[^.!?。！？\n\r\u2028\u2029]+(?:[.!?]+(?!\s|$)[^.!?。！？\n\r\u2028\u2029]*)*[.!?。！？]*")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without word ends.
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
_DAMAGE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")
_WIDE = re.compile(r"[\uff01-\uff9f]+")
_SKIP = regex.compile(r"[\p{M}\p{Cf}\p{Cc}]+")
#: No word repeats a letter so often; what does is damage.
_REPEAT = re.compile(r"([^\W\d_])\1{3,}")
_FOLD = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "’": "'"})


def _repair(m) -> str:
    """Bytes of UTF-8 that were read as a one-byte encoding."""
    raw = b""
    for c in m[0]:
        try:
            raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return m[0]
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def fold(text: str) -> str:
    """Lower case without marks and endless letters, with damaged encodings repaired."""
    text = _DAMAGE.sub(_repair, text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return _REPEAT.sub(r"\1", _SKIP.sub("", unicodedata.normalize("NFD", text.lower().translate(_FOLD))))


def tokens(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and blank-separated tokens of each sentence of what is not quoted, fenced or logged."""
    out, at = [], 0
    for line in _unquoted(text).split("\n"):
        kind = _LINE.match(line)
        if line and not (kind and kind.lastgroup is None):
            if kind:
                line = " " * kind.end() + line[kind.end() :]
            out += [(at + m.start(), at + m.end(), m[0].split(" ")) for m in _SPLIT.finditer(line)]
        at += len(line) + 1
    return out


def _plain(m) -> str:
    """Nothing for a run of code but the stop at its end, else the run."""
    core = m[0].rstrip(".!?,;:")
    return " " + m[0][len(core) :] if _CODE.search(core) else m[0]


def token_words(token: str) -> tuple[list[str], int, int, int]:
    """The folded words of a token that is no code, their letters, the longer ones, and letters of scripts without word ends."""
    words = _WORD.findall(fold(_RUN.sub(_plain, token)))
    return words, sum(map(len, words)), sum(len(w) > 1 for w in words), len(_DENSE.findall(token)) if words else 0


def _is_prose(letters, multi, dense):
    """Prose has several words of more than one letter, or letters of a script without word ends."""
    return (dense >= 5) | ((multi >= 3) & (letters >= 9))


def prose_words(parts: list[str], look=token_words) -> list[str]:
    """The folded words of a sentence's tokens, none if it is no prose."""
    facts = [look(t) for t in parts]
    return [w for f in facts for w in f[0]] if _is_prose(*(sum(f[i] for f in facts) for i in (1, 2, 3))) else []


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and folded words of each sentence of prose in ``text``."""
    return [(start, end, words) for start, end, parts in tokens(text) if (words := prose_words(parts))]


def word_features(word: str) -> np.ndarray:
    """Hashed n-grams of a word; in scripts without word ends those of one to three letters."""
    if _DENSE.search(word):
        grams = [word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)]
    else:
        w = f"^{word}$"
        grams = [w[i : i + n] for n in range(2, NGRAM + 1) for i in range(len(w) - n + 1)] + ["=" + word]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for g in grams], np.int64)


def codewords(count: int, bits: int = BITS, tries: int = 4000) -> np.ndarray:
    """``count`` codewords of +1 and -1, of the tried ones those with the largest least distance.

    Every bit splits the languages, so each has something to learn (one language has no split).
    """
    random, best, best_score = np.random.default_rng(11), None, -1.0
    for _ in range(tries if count > 1 else 1):
        code = np.where(random.random((count, bits)) < 0.5, -1, 1)
        if count > 1:
            flat = np.flatnonzero(np.abs(code.sum(0)) == count)
            code[random.integers(count, size=len(flat)), flat] *= -1
        dist = (bits - code @ code.T) / 2
        score = dist[~np.eye(count, dtype=bool)].min() if count > 1 else 0
        if score > best_score:
            best, best_score = code, score
    return best


class _Tokens(dict):
    """Row of each token in a table: sums of its words' weights, n-grams, letters, longer words, dense letters."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.table = weights, np.zeros((1024, weights.shape[1] + 4), np.float32)

    def __missing__(self, token: str) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row, (words, *facts) = self.table[i], token_words(token)
        row[:] = 0
        if words:
            f = np.concatenate([word_features(w) for w in words])
            row[:-4] = self.weights[f].sum(0)
            row[-4:] = len(f), *facts
        self[token] = i
        return i


@dataclass
class LanguageModel:
    """Bit classifiers with their codewords; ``predict`` decodes sentences."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.known = _Tokens(self.weights)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def sums(self, bags: list[list[str]]) -> np.ndarray:
        """The sum of each bag's token rows. Each different token is looked at once; long bags add up in pieces."""
        out = np.zeros((len(bags), self.known.table.shape[1]), np.float32)
        ids, starts, rows = [], [], []
        for i, bag in enumerate(bags):
            for k in range(0, len(bag), STEP):
                starts.append(len(ids))
                rows.append(i)
                ids.extend(map(self.known.__getitem__, bag[k : k + STEP]))
                if len(ids) >= STEP:
                    np.add.at(out, rows, np.add.reduceat(self.known.table[ids], starts))
                    ids, starts, rows = [], [], []
                    if len(self.known) > MEMO:
                        self.known = _Tokens(self.weights)
        if ids:
            np.add.at(out, rows, np.add.reduceat(self.known.table[ids], starts))
        return out

    def margins(self, sums: np.ndarray) -> np.ndarray:
        """Margin of each bit from the sums of sentences of prose."""
        return sums[:, :-4] / np.sqrt(sums[:, -4:-3]) + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language: of each bit log(1 + exp(-bit * margin)), weighted."""
        m = np.clip(margins, -30, 30)
        plus, minus = np.log1p(np.exp(-m)) * self.reliability, np.log1p(np.exp(m)) * self.reliability
        return plus @ (self.code.T == 1) + minus @ (self.code.T == -1)

    def predict(self, bags: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``decode`` of bags of words."""
        return self.decode(self.sums(bags))

    def decode(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its confidence, and the confidences of all languages."""
        loss = self.losses(self.margins(sums)) / self.temperature
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best], p


def _dense(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features that a batch uses, and its matrix over them."""
    sizes = np.array([len(f) for f in batch])
    used, at = np.unique(np.concatenate(batch), return_inverse=True)
    rows = np.repeat(np.arange(len(batch)), sizes)
    x = np.bincount(rows * len(used) + at, np.repeat(1 / np.sqrt(sizes), sizes), len(batch) * len(used))
    return used, x.reshape(len(batch), -1).astype(np.float32)


def _fit_bits(feats: list[np.ndarray], y: np.ndarray, code: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every bit by adaptive gradient steps."""
    random = np.random.default_rng(5)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    for _ in range(epochs):
        order = random.permutation(len(feats))
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            used, x = _dense([feats[j] for j in part])
            t = code[y[part]]
            m = x @ w[used] + b
            g = -t / (1 + np.exp(np.clip(t * m, -30, 30))) / len(part)
            dw, db = x.T @ g, g.sum(0)
            gw[used] += dw * dw
            gb += db * db
            w[used] -= 0.3 * dw / np.sqrt(gw[used])
            b -= 0.3 * db / np.sqrt(gb)
    return w, b


def _surprise(loss: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log confidence of the right language, none taken as surer than 0.9999."""
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p = p / p.sum(1, keepdims=True)
    return float(-np.log(np.clip(p[np.arange(len(y)), y], 1e-4, 0.9999)).mean())


def _agreeing(feats: list[np.ndarray], y: np.ndarray, classes: int, turns: int = 3) -> np.ndarray:
    """Samples whose label is also the likeliest class by n-gram frequencies of the samples kept so far.

    Most of what carries a label is of that language, so the frequencies of a class are right
    though some of its samples are not.
    """
    keep, sizes = np.ones(len(y), bool), np.array([len(f) for f in feats])
    flat, label = np.concatenate(feats), np.repeat(y, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for _ in range(turns):
        counts = np.full((classes, FEATURES), 0.1)
        for c in range(classes):
            counts[c] += np.bincount(flat[(label == c) & np.repeat(keep, sizes)], minlength=FEATURES)
        like = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        score = np.stack([np.add.reduceat(like[c][flat], starts) for c in range(classes)])
        keep = score.argmax(0) == y
    return keep


def _voted(by: dict[str, list[list[str]]]) -> dict[str, list[list[str]]]:
    """Sentences that come under several labels stay only under the one that has most of them."""
    votes: dict[str, collections.Counter] = {}
    for lang, bags in by.items():
        for words in bags:
            votes.setdefault(" ".join(words), collections.Counter())[lang] += 1
    return {lang: [words for words in bags if (v := votes[" ".join(words)])[lang] == max(v.values())] for lang, bags in by.items()}


def train(samples: list[tuple[str, str]], *, per_language: int = 2500, per_document: int = 4, epochs: int = 5, least: int = 10) -> LanguageModel | None:
    """Fit the model on (text, language); labels may be wrong or name one of several languages.

    Sentences that contradict their document's label are left out: by the label that most
    documents with the sentence have, and by the n-gram frequencies of all labels. Languages with fewer than ``least`` documents are not learned; None if
    none is left.
    """
    counts: dict[str, int] = {}
    for _, lang in samples:
        counts[lang] = counts.get(lang, 0) + 1
    langs = sorted(x for x, n in counts.items() if n >= least)
    if not langs:
        return None
    random = np.random.default_rng(3)
    by: dict[str, list[list[str]]] = {x: [] for x in langs}
    look = functools.lru_cache(MEMO)(token_words)
    for text, lang in sorted(samples):
        if lang in by:
            # A few sentences a document, so that short ones weigh as much; and part of one, since sentences may be short.
            all_parts = [parts for _, _, parts in tokens(text)]
            found = list(itertools.islice(filter(None, (prose_words(all_parts[i], look) for i in random.permutation(len(all_parts)))), per_document))
            by[lang] += found * (SHORT_WEIGHT if len(found) <= 2 else 1)
            if found and len(found[0]) > 5:
                i = int(random.integers(len(found[0]) - 4))
                by[lang].append(found[0][i : i + 4])
    by = _voted(by)
    bags, y = [], []
    for i, lang in enumerate(langs):
        for j in random.permutation(len(by[lang]))[:per_language]:
            bags.append(by[lang][j])
            y.append(i)
    y = np.array(y)
    memo: dict[str, np.ndarray] = {}
    feats = [np.concatenate([memo.setdefault(w, word_features(w)) if w not in memo else memo[w] for w in words]) for words in bags]
    code = codewords(len(langs))
    fold_of = random.integers(5, size=len(y))
    keep = _agreeing(feats, y, len(langs))
    train_on = np.flatnonzero(keep & (fold_of != 0))
    w, b = _fit_bits([feats[i] for i in train_on], y[train_on], code, epochs)
    model = LanguageModel(langs, code, w, b, np.ones(code.shape[1], np.float32))
    held = np.flatnonzero(keep & (fold_of == 0))
    if len(held):
        m = model.margins(model.sums([bags[i] for i in held]))
        right = ((m > 0) == (code[y[held]] > 0)).mean(0)
        model.reliability = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
        loss = model.losses(m)
        model.temperature = min((2.0**i for i in range(7)), key=lambda t: _surprise(loss / t, y[held]))
    return model


def training_sample(docs: DataFrame, per_language: int = 600, longest: int = 5000) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each label, the same ones whatever the partitions.

    Texts over ``longest`` characters are not trained on, so the driver gets a bounded sample. A
    text that occurs under several labels is left out but under the one that it has most often.
    """
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    low = fold_key(F.col("lang"))
    lang = F.coalesce(names[low], names[F.trim(F.split(low, _REGION)[0])])
    texts = docs.where(F.col("text").isNotNull() & F.length("text").between(20, longest)).select(lang.alias("code"), "text", F.xxhash64("text").alias("h")).where(F.col("code").isNotNull())
    w = Window.partitionBy("code").orderBy("h", "text")
    picked = texts.withColumn("at", F.row_number().over(w)).where(F.col("at") <= per_language).select("code", "text", "h").collect()
    if not picked:
        return []
    # How often each picked text has which label in the whole table: one scan of hashes against a bounded list.
    mine = docs.sparkSession.createDataFrame([(h,) for h in sorted({r.h for r in picked})], "h bigint")
    votes: dict[int, dict[str, int]] = {}
    for r in texts.select("h", "code").join(F.broadcast(mine), "h").groupBy("h", "code").count().collect():
        votes.setdefault(r.h, {})[r.code] = r["count"]
    return [(r.text, r.code) for r in picked if all(n < votes[r.h][r.code] for c, n in votes[r.h].items() if c != r.code)]


def _top_two(p: np.ndarray) -> np.ndarray:
    """The second and the first confidence of each row."""
    return np.partition(p, -2, axis=1)[:, -2:] if p.shape[1] > 1 else np.column_stack([np.zeros(len(p)), p])


def _stretches(found: list[tuple], langs: list[str], best: np.ndarray, p: np.ndarray, top: np.ndarray) -> list[tuple[int, int, int, str, float, bool]]:
    """Neighbouring sentences of one language joined; an unclear sentence follows its neighbours."""
    unclear = top[:, 1] - top[:, 0] < AMBIGUOUS
    mixed = (best != best[0]).any()
    if mixed and unclear.all():
        best[:] = int(np.log(p + 1e-9).sum(0).argmax())
    elif mixed and unclear.any():
        clear = np.flatnonzero(~unclear)
        for i in np.flatnonzero(unclear):  # the nearest clear sentence in a likely language decides, the earlier of two
            likely = clear[p[i, best[clear]] >= min(top[i, 0], top[i, 1] / 2)]
            if len(likely):
                best[i] = best[likely[np.argmin(np.abs(likely - i))]]
    out, sure = [], p[np.arange(len(best)), best]
    edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)] if mixed else [0, len(best)]
    for a, b in zip(edges, edges[1:]):
        out.append((found[a][0], found[b - 1][1], b - a, langs[best[a]], float(sure[a:b].sum()) / (b - a), bool(unclear[a:b].all())))
    return out


def document_segments(text: str | None, model: LanguageModel) -> list[tuple[int, int, int, str, float, bool]]:
    """Stretches of one language: start, end, sentences, language, confidence, ambiguous."""
    found = sentences(text) if text else []
    if not found:
        return []
    best, _, p = model.predict([w for _, _, w in found])
    return _stretches(found, model.langs, best, p, _top_two(p))


def batch_segments(texts: list[str | None], model: LanguageModel) -> list[list[tuple]]:
    """``document_segments`` of many texts, whose sentences are decoded together."""
    found = [tokens(x) if x else [] for x in texts]
    ends = np.cumsum([len(x) for x in found])
    flat = [s for x in found for s in x]
    sums = model.sums([s[2] for s in flat])
    prose = np.flatnonzero((sums[:, -3] > 0) & _is_prose(*sums[:, -3:].T))
    if not len(prose):
        return [[] for _ in texts]
    best, _, p = model.decode(sums[prose])
    top, cuts = _top_two(p), np.searchsorted(prose, ends).tolist()
    return [_stretches([flat[i] for i in prose[a:b]], model.langs, best[a:b], p[a:b], top[a:b]) if b > a else [] for a, b in zip([0, *cuts], cuts)]


def document_languages(segments: list[tuple]) -> list[tuple[str, int, float]]:
    """Languages of a document: the one of its prose, or each with at least two sentences.

    If several languages have one sentence each, the first of the longest stretch counts.
    """
    if not segments:
        return []
    total: dict[str, list] = {}
    for start, end, n, lang, sure, _ in segments:
        x = total.setdefault(lang, [0, 0.0, 0])
        x[0], x[1], x[2] = x[0] + n, x[1] + n * sure, x[2] + end - start
    if len(total) > 1:
        several = {k: x for k, x in total.items() if x[0] >= 2}
        longest = max(total, key=lambda k: total[k][2])
        total = several or {longest: total[longest]}
    return [(k, x[0], x[1] / x[0]) for k, x in sorted(total.items())]


def fit_languages(docs: DataFrame, *, per_language: int = 600) -> LanguageModel | None:
    """The model of a table's labels, to be used for several runs; None without enough labelled rows."""
    return train(training_sample(docs, per_language))


def _run(docs: DataFrame, per_language: int, model: LanguageModel | None, schema: str, rows) -> DataFrame:
    """Train unless a model is given, broadcast it (4 MB) and give each document's rows."""
    spark = docs.sparkSession
    model = model or fit_languages(docs, per_language=per_language)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(x.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_slices(batches, "text"):
            found = batch_segments(b.column("text").to_pylist(), m)
            out = [(i, *r) for i, lang, x in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), found) if x for r in rows(x, lang)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for c, n in zip(zip(*out), names)], schema=arrow)

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), 2).mapInArrow(run, schema)


def language_segments(docs: DataFrame, *, per_language: int = 600, model: LanguageModel | None = None) -> DataFrame:
    """Every stretch of prose with its language: doc_id, start_char, end_char, sentences, lang, confidence, ambiguous.

    Null, empty and blank texts and texts without prose give no rows. Repeated rows are judged
    each on their own, a null doc_id stays null, extra columns are ignored. Without enough
    labelled rows to train on the result is empty. A ``model`` of ``fit_languages`` spares the training.
    """
    return _run(docs, per_language, model, "doc_id bigint, start_char int, end_char int, sentences int, lang string, confidence double, ambiguous boolean", lambda found, _: found)


def label_findings(docs: DataFrame, *, per_language: int = 600, model: LanguageModel | None = None) -> DataFrame:
    """Languages that a document's label does not name: doc_id, lang, sentences, confidence.

    ``docs``: doc_id, text, lang. A label names a language by any ISO 639 code, with or without
    a region, or by its English name, in any letter case; other labels and null name none.
    """

    def rows(found, lang):
        named = label_code(lang)
        return [x for x in document_languages(found) if x[0] != named]

    return _run(docs, per_language, model, "doc_id bigint, lang string, sentences int, confidence double", rows)
