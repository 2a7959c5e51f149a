"""Personal information in free text: candidate spans scored by boosted trees.

1. Generators with high recall propose overlapping spans of each kind: mail addresses (also disguised ones),
   numbers of phones and of personal documents (every longer run of digits is a candidate of both kinds), streets
   and other capitalised words with a number, and sequences of words that may be names, and logins.
2. There are no true labels, so trees are trained on a bounded sample of texts with weak labels: word lists, clear
   formats and the ways in which an author's name is written speak for or against a kind. Candidates without such
   a sign train nothing, but are scored.
3. Boosted trees score each span by features that hold none of these lists: numbers that describe its format, the
   characters beside it, how often its words occur as names and as ordinary words, and how far the words before
   and after it spoke for the kind in the sample (log odds, also of words that no list holds).
4. Scores are calibrated (Platt) on held-out candidates; the threshold of a kind is a calibrated probability of one
   half, or more where precision on the held-out ones asks for it. Of overlapping spans the best stays.

Which words are given or family names is counted over the author names of the whole table: for each word, beside how
many different words it stands and in how many ways the same two are written ("Ana Reis", "Reis, Ana", "ana.reis").
One such pair is enough to propose a name; how much it is worth is up to the trees. The counts are kept in a sketch
of bounded size, so the model that is broadcast does not grow with the data.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import strip_diacritics
from sextant.llm import boosting
from sextant.runtime import cut, sized

KINDS = ("email", "phone", "id_number", "address", "name")
#: Texts that the trees are trained on at most, and candidates of a kind.
SAMPLE_TEXTS, SAMPLE_CANDIDATES = 5000, 10000
#: Cells of a row of the count sketch: a power of two between these, at least eight times the words if the bound allows. It has two rows.
CELLS_LEAST, CELLS_MOST = 1 << 14, 1 << 18
#: What is counted of a word: words beside it as a given name, ways of writing, the same as a family name, family names of that end, author rows with it, texts with it as a plain word.
ROLES = ("given", "given_forms", "family", "family_forms", "ending", "rows", "prose")
#: Precision on held-out candidates that a threshold must reach.
PRECISION = 0.95

# Own lists of cue words for the weak labels; the features of the trees don't hold them.
TECHNICAL = set(
    "branch servico servicos service services servicio projeto project proyecto tabela table tabla fila queue cola modulo module cluster ambiente environment entorno "
    "banco database schema job pipeline repositorio repo sistema sprint release servidor server host pod topico topic bucket deploy pacote package squad time equipe team".split()
)
PERSONAL = set(
    "paciente patient cliente clienta customer usuario usuaria user senhor senhora sr sra dr dra dona mr mrs ms don oi ola hi hello hola obrigado obrigada thanks gracias att "
    "segundo falar ask nome name nombre contato contact reportado atenciosamente abs cc de com por para file".split()
)
PREPOSITIONS = {"cc", "de", "com", "por", "para", "file", "ask", "segundo"}
TITLES = {"sr", "sra", "dr", "dra", "dona", "mr", "mrs", "ms"}
PHONE_CUES = set("tel telefone telefono fone phone whats whatsapp celular cel called call ligar pelo numero confirmado number at movel mobile para".split())
ID_CUES = set("cpf rg ssn sus cns passport passaporte pasaporte documento document dni nif nie curp identidade identity tax social security health cartao numero".split())
OTHER_NUMBERS = set("cnpj protocolo protocol nota nf fatura invoice pedido order codigo code barras barcode lote batch total build commit versao version job ip ms valor parcelas ticket pr issue sprint id".split())
STREETS = r"Rua|R\.|Av\.?|Avenida|Travessa|Tv\.|Pra[çc]a|P[çc]a\.|Alameda|Al\.|Largo|Estrada|Rodovia|Calle|C/|Avda\.?|Plaza|Paseo|Rue|Boulevard|Piazza|Viale|Corso"
STREETS_AFTER = r"Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.|Drive|Boulevard|Court|Place|Way"
STREETS_JOINED = r"stra(?:ß|ss)e|str\.|gasse|weg|platz|allee"
ORDINARY = TECHNICAL | OTHER_NUMBERS | PHONE_CUES | ID_CUES | PERSONAL
CONNECTORS = {"da", "de", "do", "das", "dos", "del", "di", "van", "von"}

_NAME_PART = r"[^\W\d_][\w'’-]*"
_PLACE = r"[A-ZÀ-Ý]\w+(?: (?:d[aeo]s? )?[A-ZÀ-Ý]\w+)*"
_TAIL = rf"(?:(?:,| -|,? –)? ?\b(?:apto\.?|ap\.|apt\.?|casa|bloco|Flat|CEP|cep|piso|\d{{1,2}}º)\s*[\w-]*)*(?:(?:,| -) {_PLACE}){{0,3}}(?:,? (?:CEP )?\d{{5}}-?\d{{3}}\b)?"
ADDRESS = [
    re.compile(rf"(?<!\w)(?:{STREETS})\s+(?:{_NAME_PART}\s+){{0,5}}?{_NAME_PART},?\s*(?:n[º°.o]*\s*)?\d{{1,5}}\b{_TAIL}"),
    re.compile(rf"(?<!\w)(?:rua|avenida|travessa|praça|alameda|calle)\s+(?:{_NAME_PART}\s+){{0,5}}?{_NAME_PART},?\s*(?:n[º°.o]*\s*)?\d{{1,5}}\b{_TAIL}"),
    re.compile(rf"(?<![\w.,])\d{{1,5}} (?:{_NAME_PART} ){{1,3}}(?:{STREETS_AFTER})(?!\w)(?:, Flat \d+)?"),
    re.compile(rf"(?<!\w)[A-ZÀ-Ý]\w*(?:{STREETS_JOINED}) \d{{1,4}}\b{_TAIL}"),
]
#: A capitalised phrase with a number: what an address of an unknown kind of street looks like, and much that is none.
ADDRESS.append(re.compile(rf"(?<![\w/.-])[A-ZÀ-Ý][^\W\d_]+(?: (?:d[aeo]s? )?[A-ZÀ-Ý][^\W\d_]+){{0,3}},? (?:n[º°.o]*\s*)?\d{{1,5}}(?![\w./:-]){_TAIL}"))
STREET_WORDS = set("rua r av avenida travessa tv praca pca alameda al largo estrada rodovia calle c avda plaza paseo rue boulevard piazza viale corso".split())
ORDINARY |= STREET_WORDS
MACHINES = ("git", "ssh", "hg", "svn")
# begins where a run of letters begins and takes all of it, so that runs of any length are read once
_LOCAL = r"(?<![\w.+%-])[\w.+%-]++"
_HOST = r"[\w-]+(?:\.[\w-]+)+"
EMAIL = [
    re.compile(_LOCAL + "@" + _HOST),
    re.compile(_LOCAL + r" ?[\[({] ?(?:at|arroba|@) ?[\])}] ?[\w-]+(?:(?:\.| ?[\[({] ?(?:dot|ponto|punto) ?[\])}] ?| (?:dot|ponto|punto) )[\w-]+)+", re.I),
    re.compile(_LOCAL + r" (?:at|arroba) [\w-]+(?: (?:dot|ponto|punto) [\w-]+)+", re.I),
]
#: What a text must hold for each of the patterns to be tried.
EMAIL_SIGNS = [re.compile("@"), re.compile(r"[\[({] ?(?:at|arroba|@)", re.I), re.compile(" (?:at|arroba) ", re.I)]
NUMBER = re.compile(r"(?<![\w.,/-])(?:[+(]\s?)?\d(?:[ .\-/()]{0,2}\d)*(?:-[Xx])?(?!-?\w|[.,/]\d)")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{1,3}\d{6,8}(?![\w-])")
TOKEN = re.compile(r"[^\W\d_]+")
LOGIN = re.compile(r"(?<![\w./-])[^\W\d_]+[._][^\W\d_]+(?![\w./@-]*[\w/@])")
WORD = re.compile(r"[^\W_]+")
SENTENCE_START, SENTENCE_END = re.compile(r"\n|(?<=\w{4})[.!?…]\s"), re.compile(r"\n|[.!?…](?:\s|$)")
DATE = re.compile(r"(?:19|20)\d\d([-/.])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2(?:19|20)\d\d")
DIGIT = re.compile(r"\d")
NETWORK = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
ID_FORMATS = re.compile(r"\d{3}\.\d{3}\.\d{3}-\d\d|\d{3} \d{3} \d{3} \d\d|\d{1,2}\.\d{3}\.\d{3}-[\dXx]|\d{3}-\d\d-\d{4}|\d{3} \d{4} \d{4} \d{4}")


@lru_cache(maxsize=200_000)
def fold(s: str) -> str:
    return unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode()


class Names:
    """Counts of words as names, in a sketch (two rows of cells for each role); what was asked before is remembered."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # (roles, 2, cells), at most 65535 each
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "seen": {}}

    def facts(self, word: str) -> tuple[int, ...]:
        """The counts of ROLES for a word as written; a word's end has its own entry."""
        out = self.seen.get(word)
        if out is None:
            w = fold(word)
            one, end = self._at(w), self._at("-" + w[-4:]) if len(w) > 5 else None
            out = (*one[:4], end[4] if end is not None else 0, *one[5:])
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = out
        return out

    def _at(self, w: str) -> tuple[int, ...]:
        n = self.counts.shape[2]
        a, b = zlib.crc32(w.encode()) % n, zlib.crc32(b"~" + w.encode()) % n
        return tuple(int(x) for x in np.minimum(self.counts[:, 0, a], self.counts[:, 1, b]))

    def is_given(self, word: str) -> bool:
        return self.facts(word)[0] > 0

    def is_family(self, word: str) -> bool:
        f = self.facts(word)
        return f[2] > 0 or f[4] > 2


def name_pairs(display_names: DataFrame) -> DataFrame:
    """(a, b, form, rows): given and family name in the author names of a column ``name``, how they are written and how often."""
    t = F.regexp_replace(F.trim("name"), r"^\[[^\]]*\]\s*|\s*\([^)]*\)$", "")
    # a tag or remark beside the name, or capitals, are ways of writing too
    style = F.when(t == F.trim("name"), 0).otherwise(10) + F.when(F.upper(t) == t, 20).otherwise(0)
    full = display_names.groupBy(t.alias("t"), style.alias("style")).agg(F.count("*").alias("rows"))
    part = lambda r, i: F.regexp_extract("t", r, i)
    plain, turned, login = r"^(\p{Lu}[\p{L}'’]+) (\p{Lu}[\p{L}'’]+)$", r"^(\p{Lu}[\p{L}'’]+), (\p{Lu}[\p{L}'’]+)$", r"^(\p{Ll}{2,})[._](\p{Ll}{2,})(?:@.*)?$"
    rows = full.select("rows", F.explode(F.array(*(F.struct(part(r, i).alias("a"), part(r, j).alias("b"), (F.col("style") + k).alias("form")) for k, (r, i, j) in enumerate(((plain, 1, 2), (turned, 2, 1), (login, 1, 2)))))).alias("x")).select("rows", "x.*").where("a <> ''")
    return rows.groupBy(*(strip_diacritics(F.lower(c)).alias(c) for c in ("a", "b")), "form").agg(F.sum("rows").alias("rows"))


def learn_names(display_names: DataFrame, texts: DataFrame | None = None) -> Names:
    """Name words from a column ``name`` and how often they are plain words in a column ``text``.

    All rows count; one job brings the sketch to the driver, at most 2 * CELLS_MOST rows of seven numbers.
    """
    pairs = cut(name_pairs(display_names).groupBy("a", "b").agg(F.count("*").alias("forms"), F.sum("rows").alias("rows")))
    zero = lambda *keep: [F.col(c) if c in keep else F.lit(0).cast("bigint").alias(c) for c in ROLES]
    given = pairs.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("given"), F.max("forms").alias("given_forms"), F.sum("rows").alias("rows")).select("w", *zero("given", "given_forms", "rows"))
    family = pairs.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("family"), F.max("forms").alias("family_forms"), F.sum("rows").alias("rows")).select("w", *zero("family", "family_forms", "rows"))
    ending = pairs.where("length(b) > 5").select("b").distinct().groupBy(F.concat(F.lit("-"), F.expr("right(b, 4)")).alias("w")).agg(F.count("*").alias("ending")).select("w", *zero("ending"))
    words = cut(given.unionByName(family).unionByName(ending).groupBy("w").agg(*(F.sum(c).alias(c) for c in ROLES)))
    if texts is not None:
        lower = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\d_@./\\-])\p{Ll}{2,}(?![\p{L}\d_@/\\-])"), F.lit(0))
        used = texts.select(F.explode(F.array_distinct(F.transform(lower, strip_diacritics))).alias("w")).join(sized(words.select("w")), "w", "left_semi").groupBy("w").agg(F.count("*").alias("prose"))
        words = cut(words.unionByName(used.select("w", *zero("prose"))))
    cells = CELLS_LEAST
    while cells < CELLS_MOST and cells < 8 * words.count():
        cells *= 2
    at = F.explode(F.array(*(F.struct(F.lit(row).alias("row"), F.pmod(F.crc32(F.concat(F.lit(prefix), "w").cast("binary")), F.lit(cells)).alias("cell")) for row, prefix in enumerate(("", "~")))))
    sums = words.select("*", at.alias("at")).groupBy("at.row", "at.cell").agg(*(F.least(F.sum(c), F.lit(65535)).cast("int").alias(c) for c in ROLES)).toPandas()
    counts = np.zeros((len(ROLES), 2, cells), dtype=np.uint16)
    for k, c in enumerate(ROLES):
        counts[k, sums["row"].to_numpy(dtype=int), sums["cell"].to_numpy(dtype=int)] = sums[c].to_numpy(dtype=int)
    return Names(counts)


@dataclass
class Span:
    kind: str
    start: int
    end: int
    form: tuple[float, ...]
    word: str = ""


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str], str, str]:
    """Up to three plain words before and two after in the same sentence, and the characters beside the span."""
    before = [fold(w) for w in WORD.findall(SENTENCE_START.split(text[max(0, start - 60) : start])[-1])][-3:]
    after = [fold(w) for w in WORD.findall(SENTENCE_END.split(text[end : end + 40], maxsplit=1)[0])][:2]
    return before, after, text[start - 1 : start], text[end : end + 1]


def _number_form(s: str) -> tuple[float, ...]:
    digits = sum(c.isdigit() for c in s)
    groups = [len(g) for g in re.findall(r"\d+", s)]
    return (digits, len(groups), groups[0], groups[-1], max(groups), s.startswith("+"), s.startswith("("), s.count("."), s.count("-"), s.count(" "), s.count("/"), bool(ID_FORMATS.fullmatch(s)), s[0].isalpha(), bool(NETWORK.fullmatch(s)))


def candidates(text: str, is_author: bool, names: Names) -> list[Span]:
    """All proposed spans; they may overlap. Whole text, however long."""
    out: list[Span] = []
    for i, rx in enumerate(EMAIL):
        if not EMAIL_SIGNS[i].search(text):
            continue
        for m in rx.finditer(text):
            local = re.match(r"[\w.+%-]+", m.group()).group().lower()
            out.append(Span("email", m.start(), m.end(), (i, len(local), text[m.end() : m.end() + 1] == ":", len(m.group()) - len(local), "." in m.group()), word=local))
    if DIGIT.search(text):
        for rx in (NUMBER, PASSPORT):
            for m in rx.finditer(text):
                if sum(c.isdigit() for c in m.group()) >= 6:
                    start = m.start() + (m.group()[0] == "(" and ")" not in m.group())  # a bracket around the whole number
                    form = _number_form(text[start : m.end()])
                    out += [Span(k, start, m.end(), form) for k in (("phone", "id_number") if rx is NUMBER else ("id_number",)) if form[0] > 6 or rx is PASSPORT]
        for i, rx in enumerate(ADDRESS):
            for m in rx.finditer(text):
                out.append(Span("address", m.start(), m.end(), _address_form(m.group(), i), word=fold(WORD.search(m.group() if i not in (2, 3) else m.group()[::-1]).group())))
    if "." in text or "_" in text:
        for m in LOGIN.finditer(text):
            a, b = re.split(r"[._]", m.group())
            if names.is_given(a) or names.is_given(b) or names.is_family(b) or names.is_family(a):
                out.append(Span("name", m.start(), m.end(), (2, 1, names.is_given(a), names.is_family(b), 0, m.group().islower(), 1, is_author, *_evidence(names, a, b))))
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    known = names.seen
    i = 0
    while i < len(tokens):
        s, e, w = tokens[i]
        facts = known.get(w) or names.facts(w)
        if not (facts[0] or facts[2] or facts[4]) and len(w) > 1:
            j = i
            if w[0].isupper() and not is_author:
                j, found = _unknown_names(text, tokens, i, names)
                for a, b in found:
                    end = tokens[b][1] + (len(tokens[b][2]) == 1 and text[tokens[b][1] : tokens[b][1] + 1] == ".")
                    out.append(Span("name", tokens[a][0], end, (4, b - a + 1, False, b > a, True, False, 0, False, *_evidence(names, tokens[a][2], tokens[b][2] if b > a else "")), word=fold(tokens[a][2])))
            i = j + 1
            continue
        given = len(w) > 1 and facts[0] > 0
        initial = len(w) == 1 and w.isupper() and text[e : e + 2] == ". " and i + 1 < len(tokens) and tokens[i + 1][0] == e + 2 and names.is_family(tokens[i + 1][2])
        family = not given and len(w) > 3 and (is_author or w[0].isupper()) and (facts[2] > 0 or facts[4] > 2)
        if not (given or initial or family):
            i += 1
            continue
        j, parts, second = i, 1, False
        while j + 1 < len(tokens):
            ns, ne, nw = tokens[j + 1]
            gap = text[tokens[j][1] : ns]
            if gap == " " and nw.lower() in CONNECTORS and j + 2 < len(tokens) and text[ne : tokens[j + 2][0]] == " " and names.is_family(tokens[j + 2][2]):
                j += 2
                second, parts = True, parts + 1
            elif (gap == " " or (gap == ". " and j == i and initial)) and names.is_family(nw) and (nw[0].isupper() or w.islower()):
                j += 1
                second, parts = True, parts + 1
            elif gap == ", " and (family or (given and is_author)) and is_author and names.is_given(nw):
                j += 1
                second, parts, given = True, parts + 1, True
            elif gap == " " and len(nw) == 1 and nw.isupper() and text[ne : ne + 1] == ".":
                j += 1
                second, parts = True, parts + 1
                break
            else:
                break
        if second or text[s].isupper() or text[s - 1 : s] == "@":  # one lower-case word alone is no candidate
            end = tokens[j][1]
            if len(tokens[j][2]) == 1 and text[end : end + 1] == ".":
                end += 1
            last = tokens[j][2] if second else ""
            out.append(Span("name", s, end, (0 if given else 1 if family else 3, parts, given, second, text[s].isupper(), text[s:end].islower(), 0, is_author, *_evidence(names, w, last))))
        i = j + 1
    return out


def _unknown_names(text: str, tokens: list[tuple[int, int, str]], i: int, names: Names) -> tuple[int, list[tuple[int, int]]]:
    """Capitalised words from token ``i`` on that may name a person who is no author: the last token read and (first, last) of each proposal.

    Two words or more, at the beginning of a sentence also without the first; one word only inside a sentence, if it ends
    a phrase or follows a title. What is a name among all that is capitalised, the trees say.
    """
    j = i
    while j + 1 < len(tokens) and j < i + 3:
        gap, nw = text[tokens[j][1] : tokens[j + 1][0]], tokens[j + 1][2]
        if names.is_given(nw):
            break
        if gap == " " and nw in CONNECTORS and j + 2 < len(tokens) and text[tokens[j + 1][1] : tokens[j + 2][0]] == " " and tokens[j + 2][2][0].isupper():
            j += 2
        elif gap == " " and nw[0].isupper():
            j += 1
        else:
            break
    start = tokens[i][0]
    before = text[max(0, start - 2) : start]
    opens = len(before) < 2 or "\n" in before or before[0] in ".!?…-" and before[1] == " "
    title = i > 0 and tokens[i - 1][2][0].isupper() and fold(tokens[i - 1][2]) in TITLES and start - tokens[i - 1][1] <= 2
    if j > i:
        return j, [(i, j)] + ([(i + 1, j)] if opens and j > i + 1 else [])
    return j, [(i, i)] if title or (not opens and text[tokens[i][1] : tokens[i][1] + 1] in (",", "!", ".", ";", ">", ")", "\n", "")) else []


def _evidence(names: Names, first: str, last: str) -> tuple[float, ...]:
    """How often the first word is a given name and the last a family name (as either, for a turned name), against plain use."""
    a, b = names.facts(first), names.facts(last) if len(last) > 1 else (0,) * len(ROLES)
    log = np.log1p
    return (float(log(max(a[0], b[0]))), float(log(max(a[2], b[2]))), float(log(max(a[4], b[4]))), float(log(a[6]) - log(a[5])), float(log(b[6]) - log(b[5])), max(a[1], a[3], b[1], b[3]) if last else 0.0, float(log(min(a[5], b[5]))))


def _address_form(s: str, i: int) -> tuple[float, ...]:
    head = re.split(r"\d", s, maxsplit=1)[0] or re.split(r"[,\d]", s.lstrip("0123456789"), maxsplit=1)[0]
    words = [w for w in WORD.findall(head) if not w.isdigit()]
    return (i in (2, 3), len(s), s[0].isupper(), len(words), sum(w[0].isupper() for w in words), "," in head, bool(re.search(r"nº|n°", head)), len(s) - len(re.match(r"\D*\d*", s).group()), s.count(","), len(re.search(r"\d+", s).group()))


def weak_label(text: str, c: Span) -> int | None:
    """1 or 0 where cue words, format or ways of writing are clear, else None."""
    before, after, left, right = _context(text, c.start, c.end)
    near = set(before[-2:])
    if c.kind == "email":
        return 0 if c.form[2] and c.word in MACHINES else 1 if not c.form[2] else None
    if c.kind in ("phone", "id_number"):
        s = text[c.start : c.end]
        if NETWORK.fullmatch(s) or DATE.fullmatch(s):
            return 0
        clear_id = bool(ID_FORMATS.fullmatch(s)) or s[0].isalpha()
        bare = c.form[0] == 11 and c.form[1] == 1 and s[0] != "+" and not near & (PHONE_CUES - {"numero", "number", "para", "pelo"})
        clear_phone = s[0] in "+(" or (7 <= c.form[0] <= 12 and c.form[1] > 1 and c.form[10] == 0 and not clear_id)
        if before and (before[-1] in OTHER_NUMBERS or near & {"cnpj", "protocolo", "nota", "lote", "barras"}) and not near & (ID_CUES - {"numero"}):
            return 0
        if c.form[10] or c.form[0] > 15:
            return 0
        if c.kind == "id_number":
            return 1 if clear_id or bare else 0 if clear_phone else None
        if bare:
            return 0
        return 1 if clear_phone and (s[0] in "+(" or near & PHONE_CUES or c.form[4] <= 5) else 0 if clear_id else None
    if c.kind == "address":
        if c.word in STREET_WORDS or c.form[0]:
            return 1 if c.form[4] > 1 or (c.form[4] and c.form[0]) else None
        return 0 if c.word in TECHNICAL | OTHER_NUMBERS or near & TECHNICAL or not c.form[5] else None
    if right in ("-", "/", "_", "\\") or left in ("/", "_", "\\", "-"):
        return 0
    if near & TECHNICAL or (after and after[0] in TECHNICAL and not c.form[3]):
        return 0
    if left in ("[", "(") and right in ("]", ")") and c.form[1] == 1:  # a tag
        return 0
    given, _, _, plain, plain_last, forms, _ = c.form[8:]
    if c.form[0] == 4:  # words that no author has
        if c.word in ORDINARY or any(w.isupper() and 1 < len(w) < 5 for w in text[c.start : c.end].split()):
            return 0
        if c.form[3] and c.form[10] > 1:  # a last word that ends like several family names
            return 0 if near & TECHNICAL else 1
        return 1 if before and before[-1] in (PERSONAL - PREPOSITIONS - {"ms"}) else None
    if c.form[7]:  # an author: written in several ways, or made of plain words
        if forms > 1 or c.form[6]:
            return 1
        # one way of writing in many rows, and no other name with either word: a machine
        return 0 if max(plain, plain_last) > 0.7 or (c.form[3] and c.form[-1] > 2 and given < 1) else 1 if given > 1.5 else None
    if plain > 0.7 and not c.form[3]:
        return 0
    if c.form[6] or (c.form[3] and (forms > 1 or given > 1 or c.form[0] == 3)):
        return 1
    if before and (before[-1] in PERSONAL or before[-1] in TITLES) and text[c.start].isupper():
        return 1
    return 1 if right in (",", "!") and text[c.start].isupper() and c.form[2] and plain < 0 else None


def _cues(text: str, c: Span) -> list[tuple[str, int, str]]:
    """The words before, in and after a span, with their places."""
    before, after, _, _ = _context(text, c.start, c.end)
    return [(c.kind, place, w) for place, w in [*((-1 - i, w) for i, w in enumerate(reversed(before))), *((1 + i, w) for i, w in enumerate(after)), (0, c.word)] if w]


def _features(text: str, c: Span, cues: dict) -> list[float]:
    """Format, learned log odds of the words around and the characters beside; no word list."""
    words = {place: cues.get((kind, place, w), 0.0) for kind, place, w in _cues(text, c)}
    left, right = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    sides = [left in "/_\\-" and left != "", right in "-/_\\" and right != "", left == "@", right == ":", right in ",!;" and right != "", left in "\"'(<[" and left != "", c.start == 0 or text[c.start - 1] == "\n", c.end == len(text) or right == "\n"]
    return [*map(float, c.form), *(words.get(k, 0.0) for k in (-3, -2, -1, 0, 1, 2)), sum(words.values()), *map(float, sides)]


@dataclass(frozen=True)
class Detector:
    names: Names
    cues: dict
    trees: dict
    scale: dict  # of each kind: slope and shift from logit to calibrated logit
    least: dict

    def confidence(self, kind: str, x: np.ndarray) -> np.ndarray:
        a, b = self.scale[kind]
        return boosting.sigmoid(a * self.trees[kind].logit(x) + b)

    def find(self, rows: list[tuple[str, bool]]) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, confidence) of each text, without overlaps, in order. Equal texts are read once."""
        distinct = list(dict.fromkeys(rows))
        found = dict(zip(distinct, self._find(distinct)))
        return [found[r] for r in rows]

    def _find(self, rows: list[tuple[str, bool]]) -> list[list[tuple[str, int, int, float]]]:
        spans = [candidates(t, a, self.names) for t, a in rows]
        by_kind: dict[str, list[tuple[int, Span]]] = defaultdict(list)
        for i, found in enumerate(spans):
            for c in found:
                by_kind[c.kind].append((i, c))
        kept: list[list[tuple[str, int, int, float]]] = [[] for _ in rows]
        scored: list[list[tuple[float, int, Span]]] = [[] for _ in rows]
        for kind, some in by_kind.items():
            p = self.confidence(kind, np.array([_features(rows[i][0], c, self.cues) for i, c in some]))
            for (i, c), q in zip(some, p):
                if q >= self.least[kind]:
                    scored[i].append((float(q), c.end - c.start, c))
        for i, found in enumerate(scored):
            # a mail address or a street swallows what lies inside; else the surer, then the longer span stays
            for q, _, c in sorted(found, key=lambda x: (x[2].kind not in ("email", "address"), -x[0], -x[1], x[2].start)):
                if all(c.end <= s or c.start >= e for _, s, e, _ in kept[i]):
                    kept[i].append((c.kind, c.start, c.end, q))
            kept[i].sort(key=lambda x: x[1])
        return kept


def train(sample: list[tuple[str, bool]], names: Names, seed: int = 5) -> Detector:
    """Trees, context words, calibration and thresholds from a bounded sample of (text, is an author's name).

    A fifth of the labelled candidates is held out: trees and log odds of words never see them, calibration and thresholds use them only.
    """
    labelled: dict[str, list[tuple[str, Span, int]]] = {k: [] for k in KINDS}
    for text, is_author in sample:
        for c in candidates(text, is_author, names):
            y = weak_label(text, c)
            if y is not None and len(labelled[c.kind]) < SAMPLE_CANDIDATES:
                labelled[c.kind].append((text, c, y))
    cues, trees, scale, least = {}, {}, {}, {}
    rng = np.random.default_rng(seed)
    for kind, rows in labelled.items():
        order = rng.permutation(len(rows))
        held, rest = order[: len(rows) // 5], order[len(rows) // 5 :]
        counts: dict = defaultdict(lambda: [0, 0])
        for k in rest:
            text, c, y = rows[k]
            for cue in _cues(text, c):
                counts[cue][y] += 1
        ones = sum(rows[k][2] for k in rest)
        base = float(np.log((ones + 1) / (len(rest) - ones + 1)))
        share = 1 / (1 + np.exp(-base))
        cues |= {k: float(np.log((b + 2 * share) / (a + 2 * (1 - share))) - base) for k, (a, b) in counts.items() if a + b >= 3}
        scale[kind], least[kind] = (1.0, 0.0), 0.5
        if not rows:
            trees[kind] = boosting.Trees()
            continue
        x, y = np.array([_features(t, c, cues) for t, c, _ in rows]), np.array([float(v) for *_, v in rows])
        trees[kind] = boosting.fit(x[rest], y[rest], trees=60, depth=4)
        if len(held) > 20:
            z, t = trees[kind].logit(x[held]), y[held]
            a, b = scale[kind] = boosting.platt(z, t)
            p = boosting.sigmoid(a * z + b)
            right = np.cumsum(t[np.argsort(-p, kind="stable")]) / np.arange(1, len(p) + 1)
            enough = np.sort(p)[::-1][right >= PRECISION]
            if len(enough):  # just above the surest candidate that would spoil the precision
                less = p[p < enough.min()]
                least[kind] = max(0.5, float(less.max()) + 1e-6) if len(less) else 0.5
    return Detector(names, cues, trees, scale, least)


def rows_of(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """(origin, row_id, text) of descriptions, bodies and author names; NULL texts are left out."""
    part = lambda df, origin, row_id, text: df.select(F.lit(origin).alias("origin"), F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return part(issues, "issue", "issue_id", "description").unionByName(part(comments, "comment", "comment_id", "body")).unionByName(part(comments, "author", "comment_id", "author.displayName")).where("text is not null")


def fit(rows: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Detector:
    """A detector from ``rows_of``: name words from all author names, trees from about ``sample_texts`` texts, chosen by a hash of their ids.

    The hash is compared with a bound, so no task and not the driver sees more than it keeps; twice the number is the most.
    """
    names = learn_names(rows.where("origin = 'author'").select(F.col("text").alias("name")), rows.where("origin <> 'author'").select("text"))
    bound = int(2**31 * min(1.0, sample_texts / max(1, rows.count())))
    sample = rows.where(F.pmod(F.xxhash64("origin", "row_id"), F.lit(2**31)) < bound).select("text", "origin").limit(2 * sample_texts)
    return train(sorted((r.text, r.origin == "author") for r in sample.collect()), names)


def spans(rows: DataFrame, detector: Detector) -> DataFrame:
    """origin, row_id, kind, start_pos, end_pos (code points, end excluded), confidence: one row per occurrence.

    Each row is read whole and by itself; a text delivered twice counts twice. Empty texts have no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = shared.value.find(list(zip(pdf["text"], pdf["origin"] == "author")))
            out = [(o, r, *x) for o, r, f in zip(pdf["origin"], pdf["row_id"], found) for x in f]
            yield pd.DataFrame(out, columns=["origin", "row_id", "kind", "start_pos", "end_pos", "confidence"])

    return rows.mapInPandas(run, "origin string, row_id bigint, kind string, start_pos bigint, end_pos bigint, confidence double")


def redact(rows: DataFrame, detector: Detector) -> DataFrame:
    """origin, row_id, text and redacted, where each span is replaced by ``[KIND]``; all else stays as it is."""
    shared = rows.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], shared.value.find(list(zip(pdf["text"], pdf["origin"] == "author")))):
                at, parts = 0, []
                for kind, s, e, _ in found:
                    parts += [text[at:s], f"[{kind.upper()}]"]
                    at = e
                out.append("".join([*parts, text[at:]]))
            yield pdf.assign(redacted=out)

    return rows.mapInPandas(run, "origin string, row_id bigint, text string, redacted string")
