"""Parameter values used by the registered queries.

The driver tables contain none of the reference cue phrases, so every
lexicon-driven scorer is registered twice where useful: once with the
reference list (``lexicons``) and once with a list drawn from words that do
occur in the data, so results are not constant."""

from __future__ import annotations

# Cue phrases that occur in the generated prose.
DATA_CUES = ["the", "tion", "with", "of "]
DATA_SOURCE_PHRASES = ["of the", "in the"]

# Polarity lexicon (word, polarity), negators and intensifiers (word, factor).
POLARITY_LEXICON = [("the", 0.3), ("of", -0.5), ("and", 0.2), ("with", -0.8),
                    ("good", 0.7), ("bad", -0.7)]
NEGATORS = ["not", "is"]
INTENSIFIERS = [("very", 1.3), ("a", 1.5)]

# Twenty frequent English words, used as the stop list for the checks.
STOP_WORDS_20 = ("the of and to a in is that it for was on with be by as this are at from").split()

# Link rule that matches the driver pages (relative links, '/th' in the path).
PAGE_LINK_CONTAINS = "/th"
