"""What a text must hold, lower-cased, for a pattern to be found in it: a cheap test ahead of the pattern.

Most commits hold none of these words, and looking for a word costs a small part of what the pattern does. A word that is part of
many others (``rce`` of source) is asked for at the beginning of a word only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v

NEEDED = {
    v.VULN_CLASS: [
        "overflow", "underflow", "of bounds", "of-bounds", "after free", "after-free", "double free", "double-free", "null pointer deref", "type confusion",
        "memory leak", "memory corruption", "format string", "injection", "site scripting", "request forgery", "traversal", "zip slip", "../", "deserializ",
        "xml external entit", "billion laughs", "prototype pollution", "open redirect", "session fixation", "privilege escalation", "privesc", "sandbox escape",
        "symlink attack", "race condition", "toctou", "of check", "of-check", "timing attack", "side channel", "side-channel", "padding oracle",
        "denial of service", "dos attack", "regex denial", "catastrophic backtracking", "complexity attack", "arbitrary code ", "arbitrary command ",
        "arbitrary file ", "remote code execution", "credential leak", "credential exposure", "credential disclosure", "information leak",
        "information disclosure", "information exposure", " bypass", "access control ", "insecure ", "weak cipher", "weak crypto", "weak hash",
        "weak random", "weak prng", "insufficient entropy", "hardcoded ", "supply chain attack", "dependency confusion", "typosquat",
    ],
    v.FIX_VERB: ["fix", "patch", "resolv", "address", "prevent", "mitigat", "harden", "correct", "guard", "avoid", "reject", "sanitiz", "escap", "validat", "restrict", "disallow"],
    v.SECURITY_NOUN: ["vulnerab", "exploit", "attack", "malicious", "untrusted", "adversar", "secur", "unsafe", "unsanitized", "unvalidated", "unescaped", "spoof", "tamper", "forge", "hijack", "poison"],
    v.ADVISORY: ["reported by", "reported to us by", "discovered by", "found by", "credit", "thanks to", "disclos", "security advisory", "huntr.dev", "hackerone.com", "bugcrowd.com", "oss-fuzz", "security@", "/security/advisories/", "nvd.nist.gov"],
    v.CVE: ["cve-"],
    v.GHSA: ["ghsa-"],
    v.CWE: ["cwe-"],
    v.BOUNDS_CHECK: ["check", "validate ", "limit "],
    v.UNTRUSTED: ["malformed", "crafted", "malicious", "untrusted", "invalid input", "fuzz", "attacker", "remote ", "hostile"],
}
#: Words that a pattern asks for whole.
WHOLE_WORDS = {v.VULN_CLASS: ["oob", "uaf", "sqli", "ssti", "xss", "csrf", "xsrf", "ssrf", "xxe", "redos", "rce", "lfi", "rfi"]}


def folded(text: Column) -> Column:
    """Lower-cased, with the letters beyond ASCII that patterns without regard to case take for ASCII ones (of i, s and k) made those."""
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def may_hold(low: Column | str, pattern: str) -> Column:
    """Whether ``pattern`` can be found in the text whose ``folded`` copy is ``low``: false only if it is nowhere. The column's name in place of the column makes a plan that is built faster."""
    if isinstance(low, str):
        held = lambda words: " OR ".join(f"contains({low}, '{w}')" for w in words)
        some = held(NEEDED[pattern])
        if pattern in WHOLE_WORDS:
            whole = WHOLE_WORDS[pattern]
            some += f" OR (({held(whole)}) AND rlike({low}, '(?<![a-z0-9_])(?:{'|'.join(whole)})'))"
        return F.expr(some)
    some = reduce(or_, [low.contains(w) for w in NEEDED[pattern]])
    if pattern in WHOLE_WORDS:
        whole = WHOLE_WORDS[pattern]
        some = some | (reduce(or_, [low.contains(w) for w in whole]) & low.rlike(rf"(?<![a-z0-9_])(?:{'|'.join(whole)})"))
    return some
