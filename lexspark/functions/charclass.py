"""Character classes and lexical patterns as Java regular expressions.

The classes follow Unicode as Python's ``re`` sees it (word characters without
combining marks, the 25 white-space characters plus U+001C-U+001F), written
out because Java's shorthand differs. Runs that can't be cut short by what follows
are possessive, so nothing is tried twice. Fixed values.
"""

from __future__ import annotations

#: white space, for use inside brackets
WS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: word characters, for use inside brackets
W = r"\p{L}\p{N}_\u0C5D"
#: word boundary before and after a digit
LB = f"(?<![{W}])"
RB = f"(?![{W}])"

URL = f"(?iu:https?://[^{WS}<>\"']+|www\\.[^{WS}<>\"']+)"
EMAIL = r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DATE = rf"{LB}\p{{Nd}}{{4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}{RB}|{LB}\p{{Nd}}{{1,2}}[-/.]\p{{Nd}}{{1,2}}[-/.]\p{{Nd}}{{2,4}}{RB}"
DECIMAL = rf"{LB}\p{{Nd}}++\.\p{{Nd}}++{RB}"
INTEGER = rf"{LB}\p{{Nd}}++{RB}"
TELUGU_WORD = r"[\u0C00-\u0C7F]++"
LATIN_WORD = "[a-zA-Z]++"
PUNCT = f"[^{W}{WS}\\u0C00-\\u0C7F]"
SENT_BOUNDARY = f"(?<=[.!?\\u0964\\u0965])[{WS}]+"

#: kinds in order of priority; the first that matches at a position wins
KINDS = (("url", URL), ("email", EMAIL), ("date", DATE), ("decimal", DECIMAL), ("integer", INTEGER), ("telugu_word", TELUGU_WORD), ("latin_word", LATIN_WORD), ("punct", PUNCT))
#: what a kind begins with; a look ahead at it spares the others' longer tests
_FIRST = {"url": "[hHwW]", "email": "[a-zA-Z0-9._%+-]", "date": r"\p{Nd}", "decimal": r"\p{Nd}", "integer": r"\p{Nd}"}
def _tokens(kinds: tuple[tuple[str, str], ...]) -> str:
    """One alternation: the kinds, then any single character that isn't white space."""
    return "|".join(f"(?={_FIRST[n]})(?:{p})" if n in _FIRST else p for n, p in kinds) + f"|[^{WS}]"


TOKEN = _tokens(KINDS)
#: the same for texts without an at sign, where no e-mail need be looked for
TOKEN_NO_AT = _tokens(tuple(x for x in KINDS if x[0] != "email"))
#: a noncharacter that marks the end of a URL while sentences are split
MARK = chr(0xFDD0)
