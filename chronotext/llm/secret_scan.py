"""Secrets in documents: a character convolutional network over every candidate and its context.

A candidate is a run of signs that secrets are made of and that is long enough,
or any value assigned to a telling name, or a private-key header.  The network
sees the candidate with the signs before and after it, a long one in overlapping
windows, and the parts of a candidate between delimiters.  It is trained here, on
labelled findings that are generated from a seed: secrets of common kinds and
what looks like them but is none (hashes named as checksums, identifiers, card
and phone numbers, addresses, encoded pictures, long words), in prose of any case
and any signs around.  Each kind of candidate has its own threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm._kernels import slices

BEFORE, BODY, AFTER = 32, 56, 12
MIN_RUN = 12
MIN_RECALL, MOST = 0.995, 0.9
_RUN = r"[A-Za-z0-9+/_=.~\-]"
_NAMED = r"""(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)[A-Za-z_]{0,12}["']?\s{0,3}(?::=|=>|=|:)\s{0,3}["']?(?!-----BEGIN)(?P<named>[^\s"'<>]{6,})"""
# a run of >= MIN_RUN signs with a digit or a capital after a small letter; a value assigned to a telling name; a key header; a password in an address
CANDIDATE = re.compile(
    rf"""(?P<header>-----BEGIN\ [A-Z ]*PRIVATE\ KEY-----)
    |(?P<url>(?i:[a-z][a-z0-9+.\-]{{1,15}})://[^\s:/@"'<>]{{0,64}}:(?!//)[^\s@"'<>/]{{3,}}@)
    |{_NAMED}
    |(?<![A-Za-z0-9+/_=.~\-])(?P<run>(?={_RUN}*?(?:[0-9]|[a-z][A-Z])){_RUN}{{{MIN_RUN},}})""",
    re.X,
)
NAMED = re.compile(_NAMED)
PART = re.compile(r"[^/=.~+,;:&?|@#(){}\[\]\\]+")
_SIGN = re.compile(r"[0-9]|[a-z][A-Z]")
KEY_END = re.compile(r"-----(?:END [A-Z ]*PRIVATE KEY-----|(?P<next>BEGIN ))")
KEY_LINES = re.compile(r"(?:(?:\s|\\n|\\r)+[A-Za-z0-9+/=]{16,}(?=\s|\\|[\"']|\Z))*")
# what any candidate has; Arrow's matcher passes over other texts at a few nanoseconds a byte
HINT = r"[0-9]|[a-z][A-Z]|://|(?i:pass|pwd|secret|token|key|auth|credential)"
TYPES = ("named", "run", "header", "url")
KINDS = "abcdefghijklmnopqrstuvwxyz0123456789 .,:;=_-+/\"'@%#$&*!?()[]{}<>|\\~\n"
_CODE = np.full(256, len(KINDS) + 2, dtype=np.int64)
for _i, _c in enumerate(KINDS):
    _CODE[ord(_c)] = _i + 1
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _CODE[ord(_c)] = _i + 1
N_CODES = len(KINDS) + 3
N_IN = 10  # learned sign vectors, then: upper case, in the candidate, digit, hex letter


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate; a value of a telling name ends before closing signs.

    Values of telling names that stand inside or after a run follow at the end.
    """
    out = []
    matches = list(CANDIDATE.finditer(text))
    if any(m.lastgroup == "run" for m in matches):
        have = {m.span("named") for m in matches if m.lastgroup == "named"}
        matches += [m for m in NAMED.finditer(text) if m.span("named") not in have]
    for m in matches:
        kind = m.lastgroup
        s, e = m.span(kind)
        if kind == "url":  # the password alone
            e -= 1
            s = text.index(":", text.index("://", s) + 3) + 1
        while kind not in ("header", "url") and e > s and text[e - 1] in ".,;:!?)]}*#&%$|":
            e -= 1
        if e - s >= {"named": 6, "url": 3}.get(kind, MIN_RUN):
            out.append((s, e, kind))
    return out


def key_end(text: str, start: int) -> int:
    """Where the private key of a header that ends at `start` ends: at its END line, else with its last line of key signs."""
    m = KEY_END.search(text, start)
    if m and not m.group("next"):
        return m.end()
    return KEY_LINES.match(text, start).end()


def views(text: str, s: int, e: int, kind: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """(what is reported, what the network sees, where its context ends and begins) of one candidate.

    The candidate as a whole; windows that overlap by half along a longer one; its
    parts between delimiters, which are reported on their own.
    """
    if kind == "header":
        yield (s, key_end(text, e)), (s, e), (s, e)
        return
    yield (s, e), (s, e), (s, e)
    if e - s > BODY:
        for a in range(s, e - BODY // 2, BODY // 2):
            yield (s, e), (a, min(a + BODY, e)), (s, e)
    for m in PART.finditer(text, s, e):
        a, b = m.span()
        if MIN_RUN <= b - a < e - s and _SIGN.search(text, a, b):
            yield (a, b), (a, b), (s, b)


def windows(texts: list[str], spans: list[tuple[int, int]], around: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and flags of each span with its context; a long span shows its two ends.

    around: where the signs before end and the signs after begin, if not at the span's own ends.
    """
    n, width = len(spans), BEFORE + BODY + AFTER
    codes = np.zeros((n, width), dtype=np.int64)
    flags = np.zeros((n, width, 4), dtype=np.float32)
    for k, (t, (s, e), (s0, e0)) in enumerate(zip(texts, spans, around or spans)):
        body = t[s:e]
        if len(body) > BODY:
            body = body[: BODY // 2] + body[-(BODY - BODY // 2) :]
        before, after = t[max(0, s0 - BEFORE) : s0], t[e0 : e0 + AFTER]
        row = (before.rjust(BEFORE, "\0") + body + after).encode("latin-1", "replace")[:width]
        b = np.frombuffer(row, np.uint8)
        m = len(b)
        codes[k, :m] = np.where(b == 0, 0, _CODE[b])
        flags[k, :m, 0] = (b >= 65) & (b <= 90)
        flags[k, BEFORE : BEFORE + len(body), 1] = 1
        flags[k, :m, 2] = (b >= 48) & (b <= 57)
        flags[k, :m, 3] = ((b | 32) >= 97) & ((b | 32) <= 102)
    return codes, flags


@dataclass
class Net:
    """Sign vectors, one convolution with maximum and mean pooling, one hidden layer, a calibrated logistic output."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TYPES, 0.5))

    def logits(self, codes: np.ndarray, flags: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        x = np.concatenate([p["embed"][codes], flags], axis=2)
        k = p["conv"].shape[0] // x.shape[2]
        cols = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, k * x.shape[2])
        z = np.maximum(cols @ p["conv"] + p["cb"], 0)
        body = flags[:, : z.shape[1], 1:2]
        inside = z * body
        top, where = inside.max(axis=1), inside.argmax(axis=1)
        out_top, out_where = (z * (1 - body)).max(axis=1), (z * (1 - body)).argmax(axis=1)
        size = np.maximum(body.sum(axis=1), 1)
        mean = inside.sum(axis=1) / size
        pooled = np.concatenate([top, out_top, mean, np.log(size) / 4], axis=1)
        h = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        if keep is not None:
            keep.update(x=x, cols=cols, z=z, body=body, where=where, out_where=out_where, size=size, pooled=pooled, h=h, k=k)
        return (h @ p["w2"] + p["b2"])[:, 0]

    def score(self, codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        for lo in range(0, len(codes), 256):
            z = self.logits(codes[lo : lo + 256], flags[lo : lo + 256]) * self.scale + self.shift
            out[lo : lo + 256] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _grads(net: Net, codes: np.ndarray, flags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    keep: dict = {}
    z = net.logits(codes, flags, keep)
    p, n, f = net.p, len(y), net.p["cb"].shape[0]
    d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n)[:, None].astype(np.float32)
    g = {"w2": keep["h"].T @ d, "b2": d.sum(axis=0)}
    dh = (d @ p["w2"].T) * (keep["h"] > 0)
    g["w1"], g["b1"] = keep["pooled"].T @ dh, dh.sum(axis=0)
    dp = dh @ p["w1"].T
    dz = (dp[:, None, 2 * f : 3 * f] / keep["size"][:, None]) * keep["body"]
    i, j = np.arange(n)[:, None], np.arange(f)[None, :]
    bodies = keep["body"][:, :, 0]
    dz[i, keep["where"], j] += dp[:, :f] * bodies[i, keep["where"]]
    dz[i, keep["out_where"], j] += dp[:, f : 2 * f] * (1 - bodies[i, keep["out_where"]])
    dz *= keep["z"] > 0
    flat = dz.reshape(-1, f)
    g["conv"], g["cb"] = keep["cols"].reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
    dcols = (flat @ p["conv"].T).reshape(n, dz.shape[1], keep["k"], -1)
    dx = np.zeros_like(keep["x"])
    for t in range(keep["k"]):
        dx[:, t : t + dz.shape[1]] += dcols[:, :, t]
    e = p["embed"].shape[1]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], codes.ravel(), dx[:, :, :e].reshape(-1, e))
    g["embed"][0] = 0
    return g


def labelled_findings(n: int, seed: int) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """n texts with one candidate each and whether it is a secret."""
    r = np.random.default_rng(seed)
    sets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "UP": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "an": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "b64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "url": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", "d": "0123456789", "low": "abcdefghijklmnopqrstuvwxyz", "low9": "abcdefghijklmnopqrstuvwxyz0123456789"}

    def some(kind: str, lo: int, hi: int | None = None) -> str:
        return "".join(r.choice(list(sets[kind]), r.integers(lo, (hi or lo) + 1)))

    def one(options):
        return options[r.integers(len(options))]

    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch ung keit lich eau ment tion ue ción ado ñ ö ü é è".split()

    def signs() -> str:
        return one(list("!%&*#$.,;:?|~+-=)(")) * int(r.integers(1, 4))

    def word() -> str:
        w = "".join(one(syllables) for _ in range(r.integers(1, 5)))
        return one([w, w, w.capitalize(), w + signs(), w + one([".", ","])])

    def prose() -> str:
        w = [word() for _ in range(r.integers(0, 12))]
        if r.random() < 0.12:
            w = [x + signs() for x in w]
        text = one([" ", " ", " | ", "\n"]).join(w)
        return text.upper() if r.random() < 0.15 else text

    def quoted(v: str) -> str:
        return one(['"{}"', "'{}'", "{}", '"{}"']).format(v)

    names = ["token", "secret", "api_key", "apikey", "API_KEY", "access_key", "password", "passwd", "auth_token", "client_secret", "SECRET_KEY", "aws_secret_access_key", "pwd", "credential", "private_token", "Authorization"]

    def value() -> str:
        return one([lambda: some("hex", 32), lambda: some("hex", 40), lambda: some("hex", 64), lambda: some("an", 16, 48), lambda: some("url", 20, 44), lambda: some("b64", 40), lambda: some("hex", 12, 24), lambda: some("hex", 16, 20), lambda: some("HEX", 32, 40), lambda: some("low9", 16, 32)])()

    def weak() -> str:
        w = one([some("low", 5, 8), "".join(one(syllables[:24]) for _ in range(r.integers(3, 5))), one(["hunter", "tiger", "dragon", "summer", "monkey", "winter", "secret", "welcome"])])
        return one([w + some("d", 2, 4) + one(["!", "#", "$x", "?a"]), some("an", 9, 14), w + some("d", 1, 4), w + some("d", 1, 4), w.capitalize() + some("d", 1, 4) + one(["", "!"]), w[:3] + some("d", 2) + w[3:] + some("d", 0, 2)])

    def secret() -> tuple[str, str, str]:
        known = one([
            lambda: "AKIA" + some("UP", 16), lambda: "ASIA" + some("UP", 16), lambda: "ghp_" + some("an", 36), lambda: "gho_" + some("an", 36), lambda: "glpat-" + some("url", 20),
            lambda: "xoxb-" + some("d", 11) + "-" + some("d", 11) + "-" + some("an", 24), lambda: "sk_live_" + some("an", 24), lambda: "sk-" + some("an", 48), lambda: "AIza" + some("url", 35),
            lambda: "eyJ" + some("url", 20, 40) + "." + "eyJ" + some("url", 30, 60) + "." + some("url", 43), lambda: "npm_" + some("an", 36), lambda: "SG." + some("url", 22) + "." + some("url", 43),
            lambda: "-----BEGIN " + one(["RSA ", "EC ", "", "OPENSSH "]) + "PRIVATE KEY-----", lambda: "AKIA" + some("UP", 16), lambda: "AKIA" + some("UP", 16),
        ])
        if r.random() < 0.1:
            v = one([lambda: some("an", 6, 20), weak, weak, lambda: some("low9", 8, 16) + one(["", "!", "#x"]), lambda: some("low", 5, 12)])()
            return one(["postgres", "mysql", "https", "redis", "mongodb+srv", "amqp", "ftp"]) + "://" + one(["", some("low", 3, 8), some("low", 1, 2), "admin", "root"]) + ":", v, "@" + some("low", 3, 9) + one([":5432/db", ".example.com", "/0", ""])
        if r.random() < 0.45:
            return one(["", "", "key ", "export AWS_ACCESS_KEY_ID=", "use ", '"']), known(), one(["", " ", "\n", '"'])
        bearer = r.random() < 0.08
        v = value() if bearer or r.random() < 0.6 else weak()
        sep = one([" = ", "=", ": ", ":", " := ", " => "])
        q = quoted("\1").split("\1")
        name = "Bearer" if bearer else one(names)
        if r.random() < 0.15:
            name, v = name.upper(), v.upper()
        return name + (" " if name == "Bearer" else sep) + q[0], v, q[1]

    def other() -> tuple[str, str, str]:
        return one([
            lambda: (one(["sha1 ", "commit ", "md5: ", "sha256=", "checksum: ", "digest ", "etag ", "rev ", "sha1sum ", "commit: "]), some("hex", *one([(32, 32), (40, 40), (64, 64)])), ""),
            lambda: ("", "-".join(some("hex", k) for k in (8, 4, 4, 4, 12)), ""),
            lambda: ("id=", "-".join(some("hex", k) for k in (8, 4, 4, 4, 12)), ""),
            lambda: (one(["", "", "card ", "no. "]), some("d", 16), ""), lambda: ("", one(["4", "5", "6"]) + some("d", 15), ""), lambda: ("", "-".join(some("d", 4) for _ in range(4)), ""), lambda: ("", some("d", 12, 24), ""),
            lambda: ("", ".".join(str(r.integers(0, 256)) for _ in range(4)), ""), lambda: (one(["", "ip ", "from "]), ".".join(str(r.integers(100, 256)) for _ in range(4)), one(["", ":8080", "/24"])), lambda: ("", ".".join(str(r.integers(10, 256)) for _ in range(4)) + one(["", "/16"]), ""),
            lambda: ("", one(["+", ""]) + some("d", 1, 2) + "-" + some("d", 3) + "-" + some("d", 3) + "-" + some("d", 4), ""), lambda: ("tel ", some("d", 3) + "." + some("d", 3) + "." + some("d", 4), ""), lambda: ("mac ", "-".join(some("hex", 2) for _ in range(6)), ""),
            lambda: ("", "20" + some("d", 2) + "-" + some("d", 2) + "-" + some("d", 2) + "_" + some("d", 6), ""), lambda: ("IBAN ", one(["DE", "FR", "ES"]) + some("d", 18, 20), ""), lambda: ("", some("d", 2) + "." + some("d", 5, 7) + one(["", "-"]) + some("d", 0, 2), ""), lambda: ("", some("d", 3, 9) + "/" + some("d", 3, 6) + "-" + some("d", 4), ""),
            lambda: ("https://" + some("low", 3, 8) + ".example.com", ":" + some("d", 4) + "/" + some("low", 3, 8) + "/" + some("d", 2, 5), ""), lambda: ("", "_".join(some("low", 3, 8) for _ in range(3)) + "_" + some("d", 1, 3), ""), lambda: ("", some("low", 4, 8) + "." + some("low", 4, 8) + some("d", 1, 2) + "@" + some("low", 4, 8) + ".com", ""),
            lambda: (one(["http", "https", "git"]) + "://" + some("low", 2, 6) + ":", one(["password", "${PASS}", "<password>", "xxx", "****", "PASSWORD", "pass"]), "@" + some("low", 3, 8)), lambda: ("+1 ", "-".join([some("d", 3), some("d", 3), some("d", 4), some("d", 2)]), ""),
            lambda: ("", one(["the", "he", "in", "er", "jo"]) + "." + some("d", 1, 3) + one(["", "@"]) + "mail" + some("d", 1) + ".example.com", ""),
            lambda: (word() + "." + some("d", 2) + "@", "mail" + some("d", 1) + ".example.com", ""),
            lambda: ("", ".".join(some("d", 1, 3) for _ in range(4)) + one(["", ".1"]), ""), lambda: ("", ".".join(some("d", 3) for _ in range(4)), ""),
            lambda: ("https://", "www.example.com/" + some("low", 3, 9) + "/" + some("d", 2, 6) + "/" + some("low", 3, 12), ""),
            lambda: ("", "20" + some("d", 2) + "-" + some("d", 2) + "-" + some("d", 2) + "T" + some("d", 2) + ".00.00", ""),
            lambda: ("", some("low", 5, 12) + "-" + some("low", 4, 9) + "-" + some("d", 1, 4), ""), lambda: ("", some("low", 10, 30) + some("d", 1, 2), ""),
            lambda: ("data:image/png;base64,", some("b64", 40, 120), ""), lambda: ("version ", ".".join(some("d", 1, 2) for _ in range(3)) + "-beta." + some("d", 1, 4), ""),
            lambda: (one(["token", "password", "secret", "api_key"]) + one([" = ", ": ", "="]), one(["${TOKEN}", "<your-token>", "os.environ", "changeme", "example", "required", "xxxxxxxxxxxx", "********", "getenv(TOKEN)", "null,null"]), ""),
            lambda: (one(["token", "auth", "password", "secret"]) + ": ", some("low", 6, 14), ""), lambda: ("", "=" * 9 + some("d", 1, 3) + "=" * 9, ""), lambda: ("", "".join(one(syllables[:24]).capitalize() for _ in range(r.integers(4, 9))), ""), lambda: ("ISBN ", some("d", 3) + "-" + some("d", 1) + "-" + some("d", 4) + "-" + some("d", 4), ""),
            lambda: ("", one(["v", "file_", "img_"]) + some("d", 8, 14) + one([".png", ".txt", ".json"]), ""), lambda: ("", word().strip(".,!%&*#") + some("d", 1, 4) + word().strip(".,!%&*#") + word().strip(".,!%&*#"), ""),
        ])()

    texts, spans, y = [], [], np.zeros(n, dtype=np.float32)
    for k in range(n):
        y[k] = k % 2
        a, v, b = secret() if y[k] else other()
        pre = prose()
        pre += one([" ", " ", "\n"]) if pre else ""
        texts.append(pre + a + v + b + one([" ", "", ". ", "\n", "%%% ", ", "]) + prose())
        spans.append((len(pre) + len(a), len(pre) + len(a) + len(v)))
    return texts, spans, y


@lru_cache(maxsize=2)
def train(n: int = 10000, epochs: int = 8, seed: int = 1, filters: int = 24, width: int = 5) -> Net:
    """The network; the last quarter of the findings calibrates it and sets the thresholds.

    Calibration is a logistic map of the logits; the threshold of a kind is the
    highest one that keeps the recall on those findings of the kind at MIN_RECALL or
    above, and MOST at most.
    """
    r = np.random.default_rng(seed)
    texts, spans, y = labelled_findings(n, seed)
    codes, flags = windows(texts, spans)
    fit = np.arange(n) < n * 3 // 4
    wide = N_IN + flags.shape[2]
    init = lambda a, b: (r.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32)
    net = Net({"embed": (r.standard_normal((N_CODES, N_IN)) * 0.3).astype(np.float32), "conv": init(width * wide, filters), "cb": np.zeros(filters, np.float32), "w1": init(3 * filters + 1, 24), "b1": np.zeros(24, np.float32), "w2": init(24, 1), "b2": np.zeros(1, np.float32)})
    net.p["embed"][0] = 0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, own = 0, np.flatnonzero(fit)
    for epoch in range(epochs):
        rate = 0.004 * (1 - 0.8 * epoch / epochs)
        for at in np.array_split(r.permutation(own), len(own) // 64):
            g = _grads(net, codes[at], flags[at], y[at])
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(~fit)
    z = np.concatenate([net.logits(codes[h], flags[h]) for h in np.array_split(held, 8)])
    a, b = 1.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a -= 0.02 * float(((q - y[held]) * z).mean())
        b -= 0.2 * float((q - y[held]).mean())
    net.scale, net.shift = max(a, 1e-3), b
    q = net.score(codes[held], flags[held])
    kinds = np.array([kind_of(texts[h], spans[h]) for h in held])
    for kind in TYPES:
        own = q[(kinds == kind) & (y[held] == 1)]
        if len(own):
            net.thresholds[kind] = min(MOST, float(np.quantile(own, 1 - MIN_RECALL, method="lower")))
    return net


def kind_of(text: str, span: tuple[int, int]) -> str:
    """Kind of the candidate that a labelled finding is in."""
    return next((kind for s, e, kind in candidates(text) if s < span[1] and span[0] < e), "run")


def hinted(texts: pa.Array) -> np.ndarray:
    """Indices of the texts that may have a candidate."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False))


def scan(texts: list[str | None], net: Net) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, kind, probability) of all that the network takes for a secret; what overlaps is one, with the largest probability."""
    seen = ((k, kind, v) for k, t in enumerate(texts) if t for s, e, kind in candidates(t) for v in views(t, s, e, kind))
    hits = []
    while block := list(islice(seen, 4096)):
        p = net.score(*windows([texts[k] for k, _, _ in block], [v[1] for _, _, v in block], [v[2] for _, _, v in block]))
        hits += [(k, *v[0], kind, float(q)) for (k, kind, v), q in zip(block, p) if q >= net.thresholds[kind]]
    out: list[tuple[int, int, int, str, float]] = []
    for k, s, e, kind, q in sorted(hits, key=lambda h: (h[0], h[1], -h[2])):
        if out and out[-1][0] == k and s < out[-1][2]:
            _, a, b, was, top = out[-1]
            out[-1] = (k, a, max(b, e), was, max(top, q))
        else:
            out.append((k, s, e, kind, q))
    return out


def secrets(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, probability) of each secret, in characters of the text.

    kind: "named" (a value of a telling name), "run", "header" or "url" (a password
    in an address).  Texts without a
    digit, a capital inside a word or a telling word are passed over.

    Null and empty texts have no rows; null ids stay null; repeated rows each
    give theirs.  Whole texts are scanned, long candidates in overlapping windows;
    a header reaches to the END line of its key.  What overlaps is one finding, with
    the first one's kind.  Empty tables give no rows; other columns are ignored.
    Ids are cast to long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                some = pa.array(hinted(piece.column("text")))
                hits = scan(piece.column("text").take(some).to_pylist(), sent.value)
                k, s, e, kind, p = zip(*hits) if hits else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(some).take(pa.array(k, pa.int64())), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(kind, pa.string()), pa.array(np.round(np.array(p, float), 6))],
                    names=["doc_id", "start", "end", "kind", "probability"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start int, end int, kind string, probability double")


def redact_secrets(docs: DataFrame, net: Net | None = None, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret replaced by `mark`; all rows and columns stay, the length column follows the text if there is one.

    Null and empty texts, null ids and repeated rows stay as they are; whole texts
    are read.  A null length of a text with a secret becomes the length of what is
    left.  No rows give no rows; other columns, whatever their names, aren't touched.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net or train())
    has_length = length_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                some = hinted(piece.column(text_col))
                hits = [(some[k], *rest) for k, *rest in scan(piece.column(text_col).take(pa.array(some)).to_pylist(), sent.value)]
                texts = piece.column(text_col).to_pylist() if hits else []
                for k, s, e, *_ in reversed(hits):  # from the end, so that earlier places stay
                    texts[k] = texts[k][:s] + mark + texts[k][e:]
                if hits:
                    at = piece.schema.get_field_index(text_col)
                    piece = piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.schema.field(at).type))
                    if has_length:
                        at = piece.schema.get_field_index(length_col)
                        sizes = piece.column(at).to_pylist()
                        for k in {h[0] for h in hits}:
                            sizes[k] = len(texts[k])
                        piece = piece.set_column(at, piece.schema.field(at), pa.array(sizes, piece.schema.field(at).type))
                yield piece

    return docs.mapInArrow(run, docs.schema)
