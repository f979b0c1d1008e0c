"""Word lists, phrases, multipliers and signal weights.

These must be equal for equal results, so they are stated plainly.
"""

from __future__ import annotations


def _lines(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.strip().splitlines())


# --- fixed values ------------------------------------------------------------

STOPWORDS = tuple("""
a an the is it of to in on at and or but for with as be been are was were this that these those by
from into you your we our they their i me my he she his her them us if so no not do does did have has
had can could would should will just than then there here what which who whom when where why how any all every
some one two more most such both either neither also yet very much many via out over about between while
""".split())

VAGUE_TERMS = tuple("""
revolutionary cutting-edge game-changing next-generation seamless synergy robust innovative unprecedented
leverage optimize transformative world-class holistic dynamic powerful comprehensive scalable future-proof
paradigm ecosystem tapestry landscape empower streamline vibrant elevate groundbreaking state-of-the-art
bespoke transform synergistic agile frictionless
""".split())

UNSUPPORTED_CLAIMS = tuple("""
guaranteed proven always never best-in-class industry-leading unmatched definitive superior
world-renowned award-winning undeniable indisputable flawless ultimate unparalleled unrivaled
""".split())

CLAIM_VERBS = tuple("""
improve increase reduce prevent protect detect ensure eliminate solve deliver enable boost accelerate maximize
""".split())

TRANSITIONS = tuple("""
moreover furthermore additionally however consequently therefore nonetheless nevertheless
ultimately notably importantly indeed essentially crucially fundamentally interestingly remarkably
significantly arguably likewise
""".split())

UNSUPPORTED_PHRASES = _lines("""
everyone knows
studies show
experts agree
without a doubt
research proves
scientists agree
it is clear that
it is widely known
common knowledge
needless to say
it goes without saying
as we all know
""")

FILLER_PHRASES = _lines("""
in today's fast-paced world
it is important to note
it's important to note
it is worth noting
it's worth noting
it is worth mentioning
it's worth mentioning
at the end of the day
this article will explore
delve into
unlock the power
take it to the next level
when it comes to
in the realm of
in this day and age
in the world of
navigating the complexities
in the ever-evolving
play a crucial role
play a pivotal role
the bottom line
first and foremost
in essence
a testament to
speaks volumes
in the grand scheme of things
at the heart of
a deep dive into
the ever-changing landscape
stand the test of time
a double-edged sword
the lifeblood of
when it comes down to it
shed light on
pave the way
the secret sauce
the name of the game
""")

TEMPLATE_PHRASES = _lines("""
as an ai language model
i cannot browse the internet
in conclusion,
overall,
whether you're
look no further
here are some key
let's dive in
let's explore
i hope this helps
feel free to ask
let me know if you have
of course!
certainly!
absolutely!
great question
i'm sorry, but
as an ai
i am an ai
as a language model
you might be wondering
let's take a closer look
here's a breakdown
here's the breakdown
let's dive deeper
to put it simply
to sum it up
in summary,
key takeaways
tl;dr
in short,
hope this helps!
happy to help
i'd be happy to
great point
you're absolutely right
let's get started
without further ado
""")

SEO_PHRASES = _lines("""
ultimate guide
everything you need to know
top tips
must-read
click here
boost your
rank higher
game changer
deep dive
supercharge
next-level
level up your
in this article
read on
keep reading
the complete guide
step-by-step guide
pro tip
here's why
""")

RHETORIC_PHRASES = _lines("""
here's the thing
here is the thing
let's break it down
let's break this down
the result?
the takeaway?
the bottom line?
at its core
in a world where
more than just
but here's the kicker
the kicker?
think of it like
think of it as
the beauty of
this is where
the magic happens
let that sink in
what does this mean for you
so what does this mean
buckle up
plot twist
long story short
""")

#: Signal: (category, weight), in order of emission.
SIGNALS = {
    "vague_language": ("clarity", 0.18),
    "unsupported_claims": ("evidence", 0.22),
    "unsupported_claim_phrases": ("evidence", 0.22),
    "filler_phrases": ("clarity", 0.20),
    "template_or_ai_scars": ("authenticity", 0.18),
    "seo_or_clickbait_phrases": ("manipulation", 0.14),
    "frontier_rhetoric": ("authenticity", 0.14),
    "transition_word_stuffing": ("structure", 0.14),
    "em_dash_overuse": ("authenticity", 0.16),
    "evasion_obfuscation": ("manipulation", 0.22),
    "contrastive_negation": ("authenticity", 0.16),
    "rule_of_three": ("structure", 0.12),
    "over_structuring": ("structure", 0.12),
    "repetitive_terms": ("originality", 0.16),
    "repeated_phrases": ("originality", 0.16),
    "long_sentences": ("clarity", 0.10),
    "low_burstiness": ("structure", 0.12),
    "low_specificity": ("specificity", 0.14),
    "evidence_gap": ("evidence", 0.18),
    "unsupported_claim_sentences": ("evidence", 0.14),
    "keyword_stuffing": ("manipulation", 0.14),
    "repeated_sentence_starts": ("structure", 0.10),
    "low_vocabulary_diversity": ("originality", 0.14),
}

#: Profile: signal: multiplier of its weight.
PROFILES = {
    "general": {},
    "soc": {"vague_language": 0.55, "filler_phrases": 0.65, "long_sentences": 0.5, "over_structuring": 0.6, "rule_of_three": 0.7},
    "marketing": {"vague_language": 0.5, "seo_or_clickbait_phrases": 0.5, "unsupported_claims": 1.0, "unsupported_claim_phrases": 1.0},
    "academic": {"template_or_ai_scars": 0.7, "contrastive_negation": 0.7},
    "support": {"long_sentences": 0.6, "transition_word_stuffing": 0.7, "over_structuring": 0.7},
}

DIMENSIONS = ("clarity", "evidence", "specificity", "originality", "manipulation", "structure", "authenticity")

INVISIBLE = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x180E, 0x200E, 0x200F, 0x061C)
BIDI = (0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
EXOTIC_SPACES = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
#: Look-alike code points and the ASCII letters they stand for.
HOMOGLYPHS = (
    # Cyrillic, lower and upper case
    (0x0430, "a"), (0x0435, "e"), (0x043E, "o"), (0x0440, "p"), (0x0441, "c"), (0x0445, "x"), (0x0443, "y"), (0x0456, "i"),
    (0x0458, "j"), (0x0455, "s"), (0x043A, "k"), (0x04BB, "h"), (0x0501, "d"), (0x051B, "q"), (0x0461, "w"),
    (0x0410, "A"), (0x0412, "B"), (0x0415, "E"), (0x041A, "K"), (0x041C, "M"), (0x041D, "H"), (0x041E, "O"), (0x0420, "P"),
    (0x0421, "C"), (0x0422, "T"), (0x0425, "X"), (0x0405, "S"), (0x0406, "I"), (0x0408, "J"),
    # Greek, lower and upper case
    (0x03BF, "o"), (0x03B1, "a"), (0x03BD, "v"), (0x03C1, "p"), (0x03C4, "t"), (0x03B5, "e"), (0x03B9, "i"), (0x03BA, "k"), (0x03C5, "u"),
    (0x039F, "O"), (0x0391, "A"), (0x0392, "B"), (0x0395, "E"), (0x0397, "H"), (0x0399, "I"), (0x039A, "K"), (0x039C, "M"),
    (0x039D, "N"), (0x03A1, "P"), (0x03A4, "T"), (0x03A7, "X"), (0x0396, "Z"),
)
CURLY = {"‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"', "´": "'", "«": '"', "»": '"'}
