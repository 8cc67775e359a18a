"""Toxicity scores by weak supervision.

Voters (``VOTERS`` hand-written ones, and mined ones) look at a text's words: small
lexicons by kind of insult and language, patterns, and words and word beginnings that
stand out in toxic texts, the strongest a voter each and the others in tiers. A generative label
model, two classes of several kinds of texts with firing rates of their own, is fitted to the
votes of labelled and unlabelled rows alike by expectation maximisation. It estimates the
accuracy of each voter, and the correlations between voters given the class, which
discount voters that say the same. Labels anchor it: the rates start from labelled rows,
which count in every estimate as what they are. No posterior sees its row's label: all
come from the votes alone. The posterior labels of all these rows, labelled or not, train a
logistic regression on the voters' counts, which scores every text.

The model is fitted on bounded samples (``FIT_ROWS`` labelled rows, as many unlabelled
ones, ``FIT_CHARS`` characters in either); words are mined on one half of the labelled
rows and the rates they start from measured on the other. The scores cover every row
and every whole text. Inputs of a score are the text's words only.

Defined cases: null and empty texts get the score of a text in which no voter fires;
with no labelled rows, or none of one class, the hand-written voters alone decide.
Labels that are null, or whose id is null, are not used; of several labels of an id the
largest counts. Texts of any length are scored whole, in time proportional to their
length. Repeated rows give repeated results; extra columns are dropped; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidevec.llm.common import pick

FIT_ROWS = 8000  # bound on the labelled rows a model is fitted on, and on the unlabelled ones
FIT_CHARS = 40_000_000  # bound on the characters of either
SINGLE = 40  # mined entries that are a voter each
PRIOR = 5  # rows that a voter's common rate counts for in either class
LIFT = 2  # how much more often a voter with a say fires in the toxic class, for sure (at two standard deviations)
MINED = 2000  # entries of the mined lexicons at most
#: Mined lexicons, a voter each, by the least strength of their entries (see ``mine``).
TIERS = (0.7, 1.2, 1.8, 2.5, 3.5)
SHORTEST, LONGEST = 3, 8  # letters in a mined word beginning
THRESHOLD = 0.3
KINDS = 32  # kinds of rows in either class
ROUNDS = 15
CACHE = 400_000

#: Hand-written lexicons, a voter each. An entry with a star is a beginning of words.
LEXICONS = {
    "stupidity": "stupid stupidity dumb dumber dumbest dumbass",
    "idiocy": "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins",
    "halfwits": "dimwit dimwits halfwit halfwits nitwit nitwits simpleton blockhead airhead bonehead numbskull dunce",
    "ableism": "retard* spastic psycho lunatic",
    "fools": "fool fools clown clowns buffoon jester joke jokes",
    "losers": "loser losers failure failures nobody",
    "jerks": "jerk jerks creep creeps bully snob brat hypocrite liar liars coward cowards",
    "pity": "pathetic pitiful miserable laughable ridiculous",
    "worth": "worthless useless pointless hopeless incompetent",
    "disgust": "disgusting disgusted disgust repulsive revolting gross sickening nauseating",
    "contempt": "despicable contemptible vile shameful disgrace disgraceful",
    "filth": "filthy filth dirty dirtbag slime slimy sleaze",
    "garbage": "trash trashy garbage rubbish junk",
    "scum": "scum scumbag scumbags lowlife lowlifes",
    "vermin": "vermin parasite* rat rats pig pigs cockroach* maggot* leech*",
    "animals": "animal animals beast beasts ape apes savage savages",
    "ugliness": "ugly hideous fat fatso smelly stinking",
    "fuck": "fuck* motherfuck* wtf",
    "shit": "shit* bullshit crap crappy",
    "bitch": "bitch* bastard* whore* slut* skank*",
    "arse": "asshole* arsehole* ass arse jackass dumbass",
    "genitals": "cunt* dick dickhead* prick twat* wanker* tosser*",
    "oaths": "damn damned goddamn hell bloody piss*",
    "killing": "kill murder slaughter strangle stab",
    "violence": "lynch hang beat punch smash rape*",
    "extinction": "exterminate annihilate eradicate gas",
    "hate": "hate hateful loathe despise detest",
    "degradation": "subhuman* inferior degenerate* mongrel*",
    "ideology": "nazi* fascist* racist* bigot* infidel* terrorist*",
    "silencing": "stfu gtfo kys shut",
    "german idiots": "idiot* dumm* blöd* trottel* depp* schwachkopf*",
    "german obscenity": "arschloch* arsch* scheiß* scheiss* wichser* fotze* verdammt*",
    "german persons": "hurensohn* schlampe* drecksau* missgeburt* versager* schwein*",
    "german disgust": "dreck* abschaum* widerlich* ekelhaft* abartig*",
    "german contempt": "erbärmlich* wertlos* nutzlos* jämmerlich*",
    "french idiots": "idiot* imbécile* crétin* abruti* débile* stupid*",
    "french obscenity": "connard* connasse* salope* salaud* putain* merde* enculé* bâtard*",
    "french contempt": "minable* pathétique* nul nuls lamentable*",
    "french disgust": "ordure* dégueulasse* dégoûtant* raclure* déchet*",
    "spanish idiots": "idiota* imbécil* estúpid* tont* bobo*",
    "spanish obscenity": "gilipollas* cabrón* cabron* puta* puto* mierda* pendejo* joder* zorra*",
    "spanish contempt": "patétic* inútil* maldit* miserable* fracasad*",
    "spanish disgust": "basura* asqueros* escoria* asco",
}
#: Patterns over the words joined by spaces, a voter each, with words of which a text needs one for it.
PATTERNS = {
    "address": (r"\b(?:you|u|ur|your|youre) (?:are |re |r )?(?:a |an |such a |so |just |all )?(?:idiots?|morons?|stupid|dumb|losers?|clowns?|pathetic|worthless|trash|scum|disgusting)\b", "you u ur your youre"),
    "third person": (r"\b(?:he|she|they|he s|she s|theyre) (?:are |is |re )?(?:a |an |such a |so |just |all )?(?:idiots?|morons?|stupid|dumb|losers?|clowns?|pathetic|worthless|trash|scum|disgusting)\b", "he she they theyre"),
    "shut up": (r"\b(?:shut up|shut your)\b", "shut"),
    "go away": (r"\b(?:go to hell|get lost|piss off|fuck off|screw you)\b", "go get piss fuck screw"),
    "die": (r"\b(?:drop dead|kill yourself|go die)\b", "drop kill go"),
    "wish": (r"\b(?:hope|wish) (?:you|they|he|she) (?:die|dies|rot|burn|suffer)\b", "hope wish"),
    "piece of": (r"\bpiece of (?:trash|garbage|shit|crap|scum|filth)\b", "piece"),
    "kind": (r"\b(?:your|their) kind\b", "kind"),
}
VOTERS = len(LEXICONS) + len(PATTERNS)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Lookup(dict):
    """Word -> numbers of the voters it fires, worked out once a worker."""

    def __init__(self, exact: dict[str, list[int]], starts: dict[str, list[int]]):
        super().__init__()
        self.exact, self.starts = exact, starts
        self.longest = max(map(len, starts), default=0)

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = set(self.exact.get(word, ()))
        for n in range(1, min(len(word), self.longest) + 1):
            found.update(self.starts.get(word[:n], ()))
        found = tuple(sorted(found))
        if len(self) < CACHE and len(word) < 64:
            self[word] = found
        return found


@dataclass
class Model:
    names: list[str]  # of the voters
    exact: dict[str, list[int]]
    starts: dict[str, list[int]]
    patterns: list[tuple[int, str, tuple[str, ...]]]  # voter, regex, and words of which one is needed
    weights: np.ndarray
    bias: float

    def counter(self) -> Counts:
        return Counts(self)


class Counts:
    """Counts how often each voter fires on a text."""

    def __init__(self, model: Model):
        self.lookup = Lookup(model.exact, model.starts)
        self.patterns = [(j, re.compile(p), frozenset(need)) for j, p, need in model.patterns]

    def fired(self, text: str | None) -> Counter[int]:
        words = words_of(text)
        lookup = self.lookup
        out: Counter[int] = Counter()
        for hit in [h for w in words if (h := lookup[w])]:
            out.update(hit)
        if words:
            own = set(words)
            for j, p, need in self.patterns:
                if not need.isdisjoint(own) and (n := sum(1 for _ in p.finditer(" ".join(words)))):
                    out[j] += n
        return out


def _voters(mined: list[tuple[str, float]]) -> Model:
    """The hand-written voters and the mined ones, without weights yet."""
    names, exact, starts, patterns = [], {}, {}, []
    for name, text in LEXICONS.items():
        for entry in text.split():
            (starts if entry.endswith("*") else exact).setdefault(entry.rstrip("*"), []).append(len(names))
        names.append(name)
    for name, (regex, need) in PATTERNS.items():
        patterns.append((len(names), regex, tuple(need.split())))
        names.append(name)
    for i, (entry, strength) in enumerate(mined):
        if i < SINGLE:
            voter = len(names)
            names.append(f"mined {entry}")
        else:
            voter = VOTERS + min(SINGLE, len(mined)) + sum(strength > least for least in TIERS) - 1
        (starts if entry.endswith("*") else exact).setdefault(entry.rstrip("*"), []).append(voter)
    names += [f"mined over {least}" for least in TIERS]
    return Model(names, exact, starts, patterns, np.zeros(len(names)), 0.0)


def mine(texts: list[str], toxic: np.ndarray, most: int = MINED) -> list[tuple[str, float]]:
    """Words and word beginnings that stand out in toxic texts, strongest first, with their strength: the
    lower bound, at two standard deviations, of the log ratio of their rates in toxic and in other texts.
    One that only repeats what those before it with the same beginning say is left out."""
    inside: dict[str, set[int]] = {}
    no: Counter[str] = Counter()
    for i, (text, label) in enumerate(zip(texts, toxic)):
        own = set(words_of(text))
        found = own | {w[:n] + "*" for w in own for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
        if label:
            for feature in found:
                inside.setdefault(feature, set()).add(i)
        else:
            no.update(found)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    strong = []
    for feature, rows in inside.items():
        a, b = len(rows), no.get(feature, 0)
        if a < 3 or a / (a + b) < 0.5:
            continue
        bound = np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if bound > TIERS[0]:
            strong.append((a * bound, feature, float(bound)))
    strong.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    out: list[str] = []
    strength: list[float] = []
    for _, feature, bound in strong:
        stem = feature.rstrip("*")
        rows = inside[feature]
        # one that only repeats what an overlapping one says adds nothing
        related = [g for g in out if g.rstrip("*").startswith(stem) or (g.endswith("*") and stem.startswith(g[:-1]))]
        covered = set().union(*(inside[g] for g in related)) if related else set()
        if len(rows - covered) < max(2, 0.15 * len(rows)):
            continue
        out.append(feature)
        strength.append(bound)
        if len(out) == most:
            break
    return list(zip(out, strength))


def _kinds(v: np.ndarray, most: int) -> np.ndarray:
    """A number for each row: which of at most ``most`` kinds of votes it is, by k-means from rows far apart."""
    centres = v.mean(0, keepdims=True)
    while len(centres) < most:
        away = ((v[:, None] - centres) ** 2).sum(2).min(1)
        if not away.max(initial=0) > 0:
            break
        centres = np.vstack([centres, v[away.argmax()]])
    for _ in range(10):
        at = ((v[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([v[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
    return at


def label_model(votes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, dict]:
    """Posterior labels of a latent class model of the votes (rows x voters, 0 or 1), and what it estimates.

    Either class is a mixture of up to ``KINDS`` kinds of rows, with firing rates of their own: voters are for one
    language or sort of insult each, so their votes depend on each other within a class.

    known: the class of some rows (1 or 0; -1 where it isn't known; -2 for rows that voters were made from, which
    would flatter them and count in no estimate). The known rows say what the classes are: the estimates start from them,
    and they count as what they are in every later one, while other rows count by their posterior. The posteriors
    returned come from the votes alone, for all rows. A voter that isn't surely ``LIFT`` times as frequent in the toxic
    class as in the other has no say. Correlations are those of the voters' residuals given the kind; a voter's
    evidence is divided by one plus the variance it shares with the others. A voter's accuracy is the share of the texts
    it fires on that are toxic.
    """
    v = votes.astype(np.float64)
    pi = float(((known == 1).sum() + 1) / ((known >= 0).sum() + 2))
    parts, toxic = [], []
    for c in (1, 0):
        rows = np.flatnonzero(known == c)
        at = _kinds(v[rows], KINDS) if len(rows) else np.zeros(0, int)
        for k in np.unique(at):
            parts.append(rows[at == k])
            toxic.append(c == 1)
    toxic = np.array(toxic)
    share = np.zeros((len(v), len(parts)))  # of each row in each kind
    for k, rows in enumerate(parts):
        share[rows, k] = 1
    counts = np.where(known >= 0, 1.0, 0.0)[:, None]  # at first, the known rows only
    own = np.stack([known != 0, known != 1], 1)[:, np.where(toxic, 0, 1)]  # the kinds a row may be of
    discount = np.ones(v.shape[1])
    for _ in range(ROUNDS):
        weighed = share * counts
        size, fired = weighed.sum(0), weighed.T @ v
        rate = (fired.sum(0) + 0.5) / (size.sum() + 1)
        # a few rows of the common rate, so that a voter that rarely fires has no say by chance
        of = {c: (fired[toxic == c].sum(0) + PRIOR * rate) / (size[toxic == c].sum() + PRIOR) for c in (True, False)}
        alpha, beta = of[True], of[False]
        a, b = fired[toxic].sum(0), fired[~toxic].sum(0)
        says = np.log(alpha / beta) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > np.log(LIFT)
        rates = (fired + PRIOR * np.where(toxic[:, None], alpha, beta)) / (size + PRIOR)[:, None]
        weight = (size + 1) / np.where(toxic, (size[toxic] + 1).sum(), (size[~toxic] + 1).sum()) * np.where(toxic, pi, 1 - pi)
        heed = discount * says
        odds = np.log(weight) + v @ (np.log(rates) * heed).T + (1 - v) @ (np.log(1 - rates) * heed).T
        alone = np.exp(odds - odds.max(1, keepdims=True))
        alone /= alone.sum(1, keepdims=True)
        share = alone * own
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        counts = np.where(known > -2, 1.0, 0.0)[:, None]
        residual = v - share @ rates
        deviation = np.sqrt((residual**2).mean(0)) + 1e-9
        rho = np.abs(residual.T @ residual / len(v) / deviation / deviation[:, None])
        np.fill_diagonal(rho, 0)
        rho[rho < 0.3] = 0  # chance
        discount = 1 / (1 + (rho[says] ** 2).sum(0))
    accuracy = pi * alpha / (pi * alpha + (1 - pi) * beta)
    return alone[:, toxic].sum(1), {"alpha": alpha, "beta": beta, "prior": pi, "correlation": rho, "accuracy": accuracy, "says": says}


def _logistic(x: np.ndarray, q: np.ndarray, penalty: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps; the bias is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - q) + ridge * w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def counted(model: Model, texts: list[str | None]) -> np.ndarray:
    """log(1 + how often) each voter fires on each text."""
    counts = model.counter()
    x = np.zeros((len(texts), len(model.names)))
    for i, text in enumerate(texts):
        for j, n in counts.fired(text).items():
            x[i, j] = np.log1p(n)
    return x


def fit(texts: list[str | None], labels: list[int], unlabelled: list[str | None] = ()) -> Model:
    """A model of labelled and unlabelled texts. Entries are mined on every other labelled text; the rates the label
    model starts from are those of the texts in between, where no entry was mined."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        model = _voters([])
        model.weights[:] = 2.0
        model.bias = -3.0
        return model
    half = np.zeros(len(toxic), bool)
    for kind in (True, False):
        half[np.flatnonzero(toxic == kind)[::2]] = True
    model = _voters(mine([t for t, h in zip(texts, half) if h], toxic[half]))
    x = counted(model, [*texts, *unlabelled])
    votes = x > 0
    known = np.full(len(x), -1)
    known[: len(toxic)] = np.where(half, -2, toxic)
    posterior, found = label_model(votes, known)
    x[:, ~found["says"]] = 0
    model.weights, model.bias = _logistic(x, posterior)
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fit on at most about fit_rows labelled documents, of those whose id ``keep`` (a column of the id) allows, and on as
    many others that it allows, chosen by hashes, with at most about fit_chars characters in either."""
    known = labels.where(keep & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col).cast("double")), F.lit(0.0))).first()
    rows = min(fit_rows, fit_chars / max(chars / max(n, 1), 1.0))  # of average length

    def share(df: DataFrame, of: int) -> DataFrame:
        return df if of <= rows else df.where(F.xxhash64("id") < F.lit(int(rows / of * 2**64) - 2**63))

    known = share(known, known.count())
    allowed = docs.where(keep)
    one = F.min("text").alias("text")
    labelled = pick(allowed, id=id_col, text=text_col).join(F.broadcast(known), "id").groupBy("id").agg(one, F.max("toxic").alias("toxic"))
    others = share(pick(allowed, id=id_col, text=text_col), n).join(F.broadcast(known), "id", "left_anti").groupBy("id").agg(one)
    sample, more = labelled.toArrow().sort_by("id"), others.toArrow().sort_by("id")
    return fit(sample.column("text").to_pylist(), sample.column("toxic").to_pylist(), more.column("text").to_pylist())


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and n_voters (how many fired) of every row."""
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts = m.counter()
        weights = m.weights.tolist()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                odds, n = [], []
                for text in part.column(1).to_pylist():
                    fired = counts.fired(text)
                    odds.append(m.bias + sum(weights[j] * np.log1p(c) for j, c in fired.items()))
                    n.append(len(fired))
                p = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(n, pa.int64())], [id_col, "score", "predicted", "n_voters"]
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_voters bigint")
