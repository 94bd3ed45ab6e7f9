"""Linear-chain conditional random field over word shapes, trained and decoded in numpy.

A token's score for each label is the sum, over the offsets of a window around it, of the weights of
the features of the token there. A token's features only depend on itself, so each distinct token
has one row of weights per offset, and scoring is a sum of gathered rows. Training is exact gradient
ascent of the log-likelihood (forward-backward, Adam); decoding is Viterbi for many sequences at
once, in step.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from tagweave.llm.pii_examples import GIVEN

#: Names may follow one another without a word between them, so they have a label for their first
#: token; of the other kinds each run of tokens is one find.
LABELS = ["O", "B-NAME", "I-NAME", "I-ADDRESS", "I-EMAIL", "I-ID", "I-PHONE"]
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
PAIRS = (-2, -1, 0, 1)  # the class of a neighbour at this offset with that of the next

_LETTERS = r"[^\W\d_]+"
#: Combining marks, soft hyphens, and the second half of a letter that was wrongly decoded into two.
_TAIL = r"(?:(?:(?<=[ÃÂ])[\u0080-\u00bf]|[\u0300-\u036f\u00ad])+(?:[^\W\d_]+)?)*"
_WORD = rf"(?:[DOdo][’'](?=[^\W\d_]))?{_LETTERS}{_TAIL}(?:-{_LETTERS}{_TAIL})*"
_PLAIN = rf"{_WORD}|[0-9]+|[█*]+|\S"
_WRAP = r"(?:\r\n|\s)?"
_MAIL = rf"[\w.+\-]+{_WRAP}(?:@|\(at\)|\[at\]|\(AT\)|\[AT\]){_WRAP}[\w\-]+(?:(?:\.|\[dot\]|\(dot\)|\[DOT\]|\(DOT\))[\w\-]+)+"
TOKEN = re.compile(rf"\s*(?:{_PLAIN})")
TOKEN_OR_MAIL = re.compile(rf"\s*(?:{_MAIL}|{_PLAIN})")
MAIL = re.compile(r"(?:@|\(at\)|\[at\])", re.I)
_TO_ZERO = bytes.maketrans(b"123456789", b"000000000")


def zeroed(text: str) -> str:
    """The text with 0 for every ASCII digit."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_ZERO).decode("utf-8", "surrogatepass")


def split(text: str) -> list[str]:
    """The tokens with the white space in front of them; white space at the end is left out."""
    return (TOKEN_OR_MAIL if MAIL.search(text) else TOKEN).findall(text)


def types_of(parts: list[str]) -> list[str]:
    """Types of tokens: a token and whether white space sets it off from the one in front. A token
    that begins a text is set off."""
    return [" " + parts[0], *parts[1:]] if parts else []


def places_of(parts: list[str]) -> list[tuple[int, int]]:
    out, at = [], 0
    for part in parts:
        at += len(part)
        out.append((at - len(part.lstrip()), at))
    return out


#: Kinds of words, for words that a text uses and the training table doesn't: fixed lists of common words.
CLASSES = {
    "title": "mr mrs ms miss dr sir madam judge justice professor prof captain sergeant inspector herr herrn frau ra rain rechtsanwalt rechtsanwältin monsieur madame mademoiselle mme mlle me maître docteur señor señora sr sra srta don doña dña dra juez jueza doctor doctora",
    "role": "witness plaintiff defendant claimant respondent appellant applicant driver nurse doctor teacher lawyer counsel clerk mayor chairman director secretary surveyor interpreter neighbour tenant landlord buyer seller mother father sister brother wife husband son daughter zeuge zeugin kläger klägerin beklagte angeklagte fahrer richter richterin gutachter nachbar mutter vater schwester bruder bürgermeister übersetzerin notar erblasserin témoin avocat avocate juge notaire maire prévenue expert experte chauffeur mère père sœur frère fils fille interprète gérant testigo letrado letrada abogado abogada magistrado magistrada notario alcalde acusada acusado perito perita madre padre hermana hermano hijo hija intérprete conductor",
    "firm": "ltd limited plc llc inc corp llp gmbh ag kg ohg se eg sa sarl sas sci sl cie bros bank banco banque sparkasse trust group holdings company co sons söhne fils hijos mutual insurance versicherung assurances seguros university universität université universidad",
    "street": "street road lane avenue drive court close way terrace square gardens place crescent hill walk boulevard mews rise st ave rd blvd row yard green grove rue quai impasse allée chemin cours route passage calle plaza avenida paseo camino ronda avda travesía cuesta straße gasse weg allee platz ring damm ufer markt",
    "body": "court tribunal council ministry office department state board committee commission parliament government gericht landgericht amtsgericht oberlandesgericht finanzamt ministerium gemeinde stadt land kammer senat cour conseil ministère préfecture mairie chambre juzgado audiencia ayuntamiento ministerio sala junta corte",
    "phone": "tel telephone phone mobile fax call ring dial switchboard telefon mobil rufnummer durchwahl handy zentrale téléphone tél portable télécopie appeler standard teléfono móvil llamar fono extensión centralita",
    "ident": "ssn passport identity insurance security tax ni nino tin id medicare pass reisepass ausweis personalausweis steuer steuernummer versicherungsnummer rentenversicherungsnummer passeport sécurité fiscal identité nir pasaporte dni nif nie documento seguridad afiliación",
    "file": "invoice docket case file register number no exhibit clause section article page paragraph rechnung aktenzeichen az akte blatt hrb seite anlage rn facture affaire dossier pièce page pourvoi factura asunto autos folio expediente página recurso rollo",
    "month": " ".join(m for months in ("january february march april may june july august september october november december", "januar februar märz mai juni juli oktober dezember", "janvier février mars avril juin juillet août septembre octobre novembre décembre", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag") for m in months.split()),
    "mark": "von van der den de del la las los du des di da dos zu zum le el mac",
    "land": "england scotland wales ireland france germany spain italy poland europe america bayern sachsen hessen deutschland österreich schweiz frankreich europa bretagne normandie alsace provence suisse belgique allemagne espagne galicia andalucía cataluña castilla españa francia méxico argentina perú north south west east new saint san santa sankt bad",
}
CLASS_OF: dict[str, list[str]] = {}
for _name, _words in CLASSES.items():
    for _word in _words.split():
        CLASS_OF.setdefault(_word, []).append(f"c={_name}")
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|allee|gasse|platz|ufer|ring|damm|steig|graben)$")
_PARTS = ((re.compile("steuer|ausweis|versicherungsn|versichertenn|reisepass|passeport|passport|pasaporte|identi"), "c=ident"), (re.compile("telefon|teléfon|téléphon|rufnummer|mobil|handynummer"), "c=phone"))
#: Features that are left out at random in training, so that none is relied on alone.
LOOSE = ("w=", "e=", "c=")
_GIVEN = frozenset(name.lower() for names in GIVEN.values() for name in names)


def features(kind: str) -> list[str]:
    """Features of a token type."""
    word = kind.lstrip()
    spaced = len(word) < len(kind)
    gap = "s" if spaced else "j"
    if len(word) > 3 and MAIL.search(word):
        return ["mail", gap]
    low = word.lower()
    first = word[0]
    if first == "0":
        return [f"d{min(len(word), 9)}", f"d{min(len(word), 9)}{gap}", "digit"]
    if first.isalpha() or first in "ÃÂ":
        if len(word) == 1:
            shape = "X" if word.isupper() else "x"
        elif word.isupper():
            shape = "XX" if len(word) == 2 else "XXX"
        elif first.isupper():
            shape = "Xx"
        else:
            shape = "x+"
        out = [f"w={low}", shape, f"{shape}{gap}", f"{shape}{min(len(word), 6)}"]
        out += CLASS_OF.get(low, [])
        if low in _GIVEN or low.partition("-")[0] in _GIVEN:
            out.append("c=given")
        if len(low) > 5:
            if _STREET_END.search(low):
                out.append("c=street")
            out += [c for part, c in _PARTS if part.search(low) and c not in out]
        if len(word) > 3:
            out += [f"e={low[-2:]}{shape[0]}", f"e={low[-3:]}{shape[0]}"]
        if "-" in word or "'" in word or "’" in word:
            out.append("joined" + shape[0])
        return out
    return [f"p={word[0]}", f"p={word[0]}{gap}"]


def look(kind: str, known) -> str:
    """The one class of a token type that neighbours are paired by. `known`: the word features that the
    training table has often enough."""
    word = kind.lstrip()
    gap = "s" if len(word) < len(kind) else "j"
    feats = features(kind)
    if feats[0] == "mail":
        return "mail"
    if feats[0][0] == "d":
        return feats[1]
    if feats[0][0] == "p":
        return (word[0] if word[0] in ".,;:()/-–+'’\"[]█*…§€&" else "?") + gap
    kinds = [f for f in feats if f[:2] == "c="]
    return f"{feats[1]}{gap}{kinds[0] if kinds else 'known' if feats[0] in known else ''}"


class Crf:
    def __init__(self, numbers: dict[str, int], weights: np.ndarray, moves: np.ndarray, looks: dict[str, int], pairs: np.ndarray):
        """weights: offset x feature x label; moves: label x label; pairs: offset x pair of classes x label."""
        self.numbers, self.weights, self.moves, self.looks, self.pairs = numbers, weights.astype(np.float32), moves.astype(np.float32), looks, pairs.astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.types: dict[str, int] = {}
        self.rows = np.zeros((len(OFFSETS), 1024, len(LABELS)), np.float32)
        self.look = np.zeros(1024, np.int32)

    def __getstate__(self):
        return self.numbers, self.weights, self.moves, self.looks, self.pairs

    def __setstate__(self, state):
        self.__init__(*state)

    def number(self, kind: str) -> int:
        """Row of a token type; 0 stands for no token."""
        n = self.types.get(kind)
        if n is None:
            n = self.types[kind] = len(self.types) + 1
            if n >= self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
                self.look = np.concatenate([self.look, np.zeros_like(self.look)])
            known = [self.numbers[f] for f in features(kind) if f in self.numbers]
            self.rows[:, n] = self.weights[:, known].sum(1)
            self.look[n] = self.looks.get(look(kind, self.numbers), 0)
        return n

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Labels of each sequence of token types; none at all where every label is O."""
        if len(self.types) > 150_000:
            self.clear()
        get, number = self.types.get, self.number
        flat = np.array([get(k) or number(k) for s in sequences for k in s], np.int32)
        sizes = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(sizes)
        coded = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        order = np.argsort(-sizes, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        at = 0
        while at < len(order):
            longest = len(coded[order[at]])
            if not longest:
                break
            size = max(1, min(4096, 150_000 // longest))
            chosen = order[at : at + size]
            for i, path in zip(chosen, self._viterbi([coded[i] for i in chosen])):
                out[i] = path
            at += size
        return out

    def _scores(self, padded: np.ndarray) -> np.ndarray:
        """Steps x sequences x labels, of types padded with 0 on both sides."""
        edge = max(OFFSETS)
        steps = padded.shape[0] - 2 * edge
        score = np.take(self.rows[0], padded[edge + OFFSETS[0] : edge + OFFSETS[0] + steps], axis=0)
        for j, o in enumerate(OFFSETS[1:], 1):
            score += np.take(self.rows[j], padded[edge + o : edge + o + steps], axis=0)
        looks = self.look[padded]
        both = looks[:-1] * len(self.looks) + looks[1:]
        for j, o in enumerate(PAIRS):
            score += np.take(self.pairs[j], both[edge + o : edge + o + steps], axis=0)
        return score

    def _viterbi(self, coded: list[np.ndarray]) -> list[np.ndarray]:
        edge, n = max(OFFSETS), len(coded)
        lengths = np.array([len(c) for c in coded])
        steps = int(lengths.max())
        padded = np.zeros((steps + 2 * edge, n), np.int32)
        for i, c in enumerate(coded):
            padded[edge : edge + len(c), i] = c
        score = self._scores(padded)
        active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
        back = np.zeros((steps, n, len(LABELS)), np.int8)
        best = score[0].copy()
        into = np.ascontiguousarray(self.moves.T)  # to x from
        for t in range(1, steps):
            k = active[t]
            paths = best[:k, None, :] + into[None]
            choice = paths.argmax(2)
            back[t, :k] = choice
            best[:k] = np.take_along_axis(paths, choice[:, :, None], 2)[:, :, 0] + score[t, :k]
        label = best.argmax(1)
        found = np.zeros((steps, n), np.int64)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            found[t, :k] = label[:k]
            if t:
                label[:k] = np.take_along_axis(back[t, :k], label[:k, None].astype(np.int64), 1)[:, 0]
        nothing = found[:0, 0]
        return [found[:k, i] if hit else nothing for i, (k, hit) in enumerate(zip(lengths.tolist(), (found != 0).any(0).tolist()))]


def label_tokens(spans: list[tuple[int, int]], marked: list[tuple[int, int, str]]) -> list[int]:
    labels = [0] * len(spans)
    for a, b, kind in marked:
        inside = [i for i, (x, y) in enumerate(spans) if x < b and y > a]
        for j, i in enumerate(inside):
            labels[i] = LABELS.index("B-NAME" if kind == "NAME" and not j else f"I-{kind}")
    return labels


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 2e-4, least: int = 12, seed: int = 5, loose: float = 0.25) -> Crf:
    """Fit to labelled texts (text, spans). Deterministic. In each step a share `loose` of the features
    of words, endings and word classes is left out."""
    numbers: dict[str, int] = {}
    types: dict[str, int] = {}
    feats: list[list[int]] = [[]]
    data = []
    tokenised = [(split(zeroed(text)), marked) for text, marked in rows]
    seen = Counter(f for parts, _ in tokenised for k in types_of(parts) for f in features(k))
    for parts, marked in tokenised:
        spans, kinds = places_of(parts), types_of(parts)
        for k in kinds:
            if k not in types:
                types[k] = len(feats)
                # rare words and endings are left out, or names would be learnt by heart
                feats.append([numbers.setdefault(f, len(numbers)) for f in features(k) if seen[f] >= least])
        data.append((np.array([types[k] for k in kinds]), np.array(label_tokens(spans, marked))))
    looks: dict[str, int] = {"": 0}
    classes = np.array([0, *(looks.setdefault(look(k, numbers), len(looks)) for k in types)])
    n_looks = len(looks)
    n_feats, n_labels, edge = len(numbers), len(LABELS), max(OFFSETS)
    width = max(map(len, feats))
    table = np.full((len(feats), width), n_feats)  # the last row of the weights stays 0
    for i, f in enumerate(feats):
        table[i, : len(f)] = f
    may_go = np.array([f.startswith(LOOSE) for f in numbers] + [False])
    weights = np.zeros((len(OFFSETS), n_feats + 1, n_labels), np.float32)
    moves = np.zeros((n_labels, n_labels), np.float32)
    pairs = np.zeros((len(PAIRS), n_looks * n_looks, n_labels), np.float32)
    m_w, v_w, m_t, v_t, m_p, v_p = (np.zeros_like(x) for x in (weights, weights, moves, moves, pairs, pairs))
    rng, step = np.random.default_rng(seed), 0
    order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    total = epochs * len(groups)
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            chosen = [data[i] for i in groups[g]]
            n, steps = len(chosen), max(len(c[0]) for c in chosen)
            padded = np.zeros((steps + 2 * edge, n), np.int64)
            gold = np.zeros((steps, n), np.int64)
            live = np.zeros((steps, n), bool)
            for i, (t, y) in enumerate(chosen):
                padded[edge : edge + len(t), i], gold[: len(t), i], live[: len(t), i] = t, y, True
            used, where = np.unique(padded, return_inverse=True)
            where = where.reshape(padded.shape)
            gone = may_go & (rng.random(n_feats + 1) < loose)
            kept = np.where(gone[table[used]], n_feats, table[used])
            rows_w = weights[:, kept].sum(2)  # offset x type x label
            score = sum(rows_w[j][where[edge + o : edge + o + steps]] for j, o in enumerate(OFFSETS))
            seen_looks = classes[padded]
            joint = seen_looks[:-1] * n_looks + seen_looks[1:]
            score = score + sum(pairs[j][joint[edge + o : edge + o + steps]] for j, o in enumerate(PAIRS))
            # forward and backward with scaling
            e = np.exp(score - score.max(2, keepdims=True))
            trans = np.exp(moves)
            alpha, scale = np.empty_like(e), np.empty((steps, n, 1), np.float32)
            cur = e[0]
            for t in range(steps):
                if t:
                    cur = np.where(live[t][:, None], (alpha[t - 1] @ trans) * e[t], alpha[t - 1])
                scale[t] = cur.sum(1, keepdims=True)
                alpha[t] = cur / scale[t]
            beta = np.ones((n, n_labels), np.float32)
            grad = np.zeros_like(score)
            g_moves = np.zeros_like(moves)
            for t in range(steps - 1, -1, -1):
                p = alpha[t] * beta
                p /= p.sum(1, keepdims=True)
                grad[t] = np.where(live[t][:, None], -p, 0)
                if t:
                    ahead = e[t] * beta
                    ok = live[t]
                    pair = alpha[t - 1][ok][:, :, None] * trans[None] * ahead[ok][:, None, :]
                    g_moves -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                    beta = np.where(ok[:, None], ahead @ trans.T, beta)
                    beta /= beta.sum(1, keepdims=True)
            grad[np.arange(steps)[:, None], np.arange(n)[None, :], gold] += live
            both = live[1:] & live[:-1]
            np.add.at(g_moves, (gold[:-1][both], gold[1:][both]), 1)
            g_w = np.zeros_like(weights)
            flat = grad.reshape(-1, n_labels)
            for j, o in enumerate(OFFSETS):
                kinds = where[edge + o : edge + o + steps].ravel()
                by_type = np.stack([np.bincount(kinds, flat[:, k], len(used)) for k in range(n_labels)], 1)
                np.add.at(g_w[j], kept, by_type[:, None, :].astype(np.float32))
            g_w[:, n_feats] = 0
            g_p = np.zeros_like(pairs)
            for j, o in enumerate(PAIRS):
                which = joint[edge + o : edge + o + steps].ravel()
                for k in range(n_labels):
                    g_p[j, :, k] = np.bincount(which, flat[:, k], n_looks * n_looks)
            step += 1
            lr = rate * (1 - step / (total + 1))
            for x, grad_x, m, v in ((weights, g_w / n - decay * weights, m_w, v_w), (moves, g_moves / n - decay * moves, m_t, v_t), (pairs, g_p / n - decay * pairs, m_p, v_p)):
                m += 0.1 * (grad_x - m)
                v += 0.01 * (grad_x**2 - v)
                x += lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights[:, n_feats] = 0
    return Crf(numbers, weights[:, :n_feats], moves, looks, pairs)
