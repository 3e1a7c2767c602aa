"""Word lists, patterns and limits that decide what the checks and scans find."""

from __future__ import annotations

# They must equal the vault format's for right results, so they stand here as they are.

#: The form of an author in a citation.
AUTHOR_FORM = r"^(?:human:[a-z0-9\-]+|team:[a-z0-9\-]+|process:[\w\-/\.]+|unknown)$"
#: Phrases that claim the present.
PRESENT = r"(?i)\b(currently|at present|as of today|still in use|remains in place)\b"
#: The unit of a compilation, where no technical batch is meant.
BATCH_WORD = (
    r"(?i)\b(?:this|these|the|one|my)\s+batch(?:es)?\b"
    r"(?!\s+(?:jobs?|files?|interfaces?|size|mode|process|processing|scripts?|runs?|imports?|exports?|updates?|operations?|windows?|systems?)\b)"
)
#: A claim that an export lost something.
EXPORT_LOSS = (
    r"(?i)(?:\bexport\b[^.\n]{0,80}?\b(?:did ?n[o']t|does ?n[o']t|never|failed to|cannot|can ?n[o']t|could ?n[o']t|without|lacks?"
    r"|omit(?:s|ted)?|drop(?:s|ped)?|strip(?:s|ped)?|lost|missing)"
    r"|\b(?:did not survive|does not survive|survives?|survived|lost|missing|stripped|dropped|omitted|absent|unavailable"
    r"|not (?:in|part of|carried|captured|present|included|kept)|cannot be (?:read|seen|checked|recovered)|link marker)\b[^.\n]{0,80}?\bexport\b"
    r"|unavailable from this corpus)"
)
#: The first person.
FIRST_PERSON = (
    r"(?<![A-Za-z0-9])(I [a-z]{2,}|[Mm]y [a-z]{2,}|in my view|to my (?:knowledge|mind)"
    r"|(?<![/-])(?:[Ww]e|[Oo]ur|ours|us|me|mine))(?![A-Za-z0-9'-])"
)
#: Words behind which an I is a pronoun, and nouns behind which it is a numeral.
CONNECTORS = (
    "and but so or nor yet that which what where when while whether because since though although if as then why how "
    "before after until unless"
).split()
NUMBERED = (
    "phase phases part parts stage stages workshop workshops training trainings project projects level levels grade tier round rounds "
    "type class section chapter volume wave waves step steps tranche lot module release version package block series scenario "
    "option alternative track war session sessions band course courses lecture unit zone category pillar milestone cohort batch act annex "
    "appendix article"
).split()
#: Letters of an enumeration.
LETTER_LIST = r"(?U)(?<!\w)[A-HJ-Z](?!\w)(?=\s*(?:,|/|\band\b|\bor\b|\bfor\b))|(?:,|\band|\bor)\s+[A-HJ-Z](?!\w)"
#: A person said to have no concept.
NO_CONCEPT = (
    r"([A-ZÄÖÜ][\wäöüéèà]+(?: [A-ZÄÖÜ][\wäöüéèà]+){1,2})"
    r"[^.\n]{0,60}?\b(?:has no concept|no concept (?:exists|of (?:his|her|their) own)|has no page of (?:his|her|their) own"
    r"|is not identified|not identified)\b"
)
#: An amount with commas.
CURRENCY_COMMA = r"\b(?:CHF|EUR|USD|GBP|kCHF|kEUR)\s?[0-9]{1,3}(?:,[0-9]{3})+(?!,?[0-9])"
#: The states of an action item, and those in which it is closed.
ITEM_STATES = ("open", "actioned", "deferred", "withdrawn")
CLOSED_STATES = ("actioned", "withdrawn")
#: Verbs of a claim about a person, and words that begin a clause and are no names.
CLAIM_VERBS = r"(?:called|convened|organised|set the brief|briefed|announced|offered|invited|wrote to|put the question|opened the|sent the)"
NO_NAMES = (
    "She He They It Alternatives Outcome Situation Decision Argument Notes Record Purpose Period Scope Course Mandate Structure Changes "
    "Related Full Mini The This That Both Each One Two Three Every Another Its His Her Their"
).split()
#: What a claim names as its period's end.
PERIOD = (
    r"\bto at least (?:the (?:sitting|page|meeting) of )?([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}|[0-9]{4})\b"
)
#: How absence is worded.
ABSENCE = (
    r"(?i)(\b(?:is|are|was|were) not (?:written out|stated|recorded|named|given|dated) (?:anywhere|in (?:this|the) (?:material|scope|archive|corpus))"
    r"|\bgives? no (?:start|end|start or end|exact) date\b"
    r"|\bno (?:other )?page in (?:this|the) (?:scope|material|archive|corpus)\b[^.\n]{0,40}\b(?:states|names|gives|records|dates|says)\b"
    r"|\bnot resolved anywhere\b"
    r"|\bnowhere in (?:this|the) (?:material|scope|corpus|archive)\b"
    r"|\bthe pages read for this concept (?:do|does) not\b"
    r"|\bdoes not record a formal close\b)"
)
#: Sections of a meeting note that are kept.
MEETING_SECTIONS = ("Summary", "Decisions", "Tasks", "Open points")
#: Words of a quotation that is looked for whole, and of a part of one that is cut.
QUOTE_WORDS, PART_WORDS = 3, 2
#: Normalised characters of a page below which its body identifies nothing, and of its head.
LEAST_BODY, HEAD = 40, 120
#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Rows of held readings that are settled.
SETTLED = r"Settled|Gap stated|Dissolved|No longer held"
#: Queues whose lengths make up the librarian's total, and those that wait for the owner.
LIBRARIAN_QUEUES = (
    "pairs_unread raw_without_fate drafts_unnamed open_question_bullets held_readings stale_claims changed_pages attachments_pending "
    "author_splits date_splits descriptions_behind stamps_behind memory_too_long body_after_footnotes paths_unresolved"
).split()
WAITING_QUEUES = ("items_open", "items_deferred", "deferred_passed")
