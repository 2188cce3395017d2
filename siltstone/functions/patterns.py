"""Word edges and white space, one rule for all patterns.

The transcripts' own language has ASCII word characters and a wide set of white space; Java's shorthands for a word
edge and for white space differ from both, so the two are spelt out here.
"""

#: No ASCII word character before, or after.
EDGE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: White space, for use inside a class; and the class.
SPACES = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACES}]"
#: The same characters, as a string.
BLANKS = " \t\n\x0B\f\r\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
