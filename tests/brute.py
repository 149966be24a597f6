"""Plain-Python detection used to check the Spark form on small texts."""

from __future__ import annotations

import hashlib
import re

from keysift.catalog import ANCHORS, RULES

_FLAGS = {"s": re.DOTALL, "i": re.IGNORECASE}
_COMPILED = [(i, r, re.compile(r.pattern, sum(_FLAGS[f] for f in r.flags))) for i, r in enumerate(RULES, 1)]
_ANCHOR = re.compile("|".join(map(re.escape, ANCHORS)), re.IGNORECASE)


def has_anchor(text):
    return bool(text) and _ANCHOR.search(text) is not None


def detect(text):
    """[(ord, sha, sample)] in detection order."""
    out, seen = [], set()
    if not has_anchor(text):
        return out
    for i, rule, pattern in _COMPILED:
        for m in pattern.finditer(text):
            value = m.group(0 if rule.whole else 1).strip()
            sha = hashlib.sha256(m.group(0).encode()).hexdigest()
            too_long = rule.max_length is not None and len(value) > rule.max_length
            if len(value) < rule.min_length or too_long or sha in seen:
                continue
            seen.add(sha)
            out.append((i, sha, value[:4] + "****" if len(value) >= 4 else "****"))
    return out


def pem_headers(text):
    return len(re.findall("-----BEGIN (?:OPENSSH |RSA |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY", text or "", re.I))
