"""Word lists, cues and formats on which results depend. They are stated as they are, in one place."""

from __future__ import annotations

# Words that are no content of a claim.
CONTENT_STOP = """the a an of to in on at for and or is are was were be been it this that these those as by with from we you they i not no
what which who whom whose when where why how do does did can could would should will""".split()

# Words that don't count when a premise is asked whether it covers a claim.
COVER_STOP = "the a an of to in on at for and or is are was were be been it this that these those as by with from we you they he she i have has had so".split()

# Words that don't count for entailment, and the words that turn a sentence's polarity.
NLI_STOP = "the a an of to in on at for and or is are was were be been it this that these those as by with from we you they he she i".split()
NEGATIONS = "not no never cannot cant wont dont doesnt didnt isnt arent wasnt werent none neither nor without n't false incorrect nothing nobody nowhere hardly barely scarcely".split()

# Words that don't count for the relevance of an answer, and words that frame a question without being its context.
RELEVANCE_STOP = """the a an of to in on at for and or is are was were be been it this that these those as by with from we you they i not no
what which who whom whose when where why how do does did say said tell about their his her""".split()
COVERAGE_FILLER = """make makes made making get gets got getting take takes took taking use uses used using work works worked working go goes going
come comes coming give gives gave given giving find finds finding put puts putting keep keeps keeping let lets letting want wants wanting need needs needing
like likes look looks looking seem seems become becomes happen happens mean means meant call calls called turn turns help helps start starts begin begins
show shows showed showing tell explain explains explaining describe describes mention mentions discuss discusses discussing cover covers covering
talk talks talking source sources video videos clip clips speaker speakers lecture episode podcast thing things way ways kind sort lot stuff topic topics idea ideas
point points part parts good bad great best better worse worst nice fine invest invests investing invested investment investments worth value valued values""".split()

# Discourse words that make no two claims speak of the same thing.
FILLER = """okay ok oh yeah yep yes nope well just really actually basically literally honestly seriously like know knows knew think thinks thinking thought
guess mean means meant say says said get gets got getting gonna wanna gotta want wants wanted let lets letting try tries trying tried one two three thing things
stuff kind sort lot lots way ways bit going goes went come comes came coming make makes made takes take took look looks looking see sees seen something someone
somebody anything anyone everything nothing nobody today now here there back around maybe perhaps right sure fine very much many also even still yet ever never
always again pretty quite rather almost enough though however thank thanks hello hey alright anyway but most important point whole matters day end down
don won didn isn aren wasn weren haven hasn doesn wouldn couldn shouldn mustn needn ain shan mightn oughtn write writes wrote note subscribe subscribed
channel comment comments bell notification notifications click sponsor sponsored watching video videos link description""".split()

# The epistemic types with their cues, in order of priority.
TYPE_CUES = [
    ("CORRECTION", ["actually", "i misspoke", "correction", "i meant", "let me correct", "to correct"]),
    ("OPINION", ["i think", "i believe", "in my opinion", "i feel", "arguably", "imo", "personally", "i'd say", "i would say", "probably", "it seems"]),
    ("PREDICTION", ["will ", "going to", "i expect", "we expect", "i predict", "in the future", "by 20", "soon"]),
    ("PROCEDURE", ["first,", "firstly", "secondly", "step ", "then ", "next,", "you should", "install", "run ", "click", "type ", "open the"]),
    ("EXAMPLE", ["for example", "for instance", "e.g", "such as"]),
    ("DEFINITION", ["is defined as", "means ", "refers to", " is a ", " is an ", " are a ", "definition"]),
]

# The predicate cues in order.
PREDICATES = [
    "is defined as", "refers to", "is a", "is an", "are a", "are the", "recommends", "recommend", "requires", "uses", "use", "shows", "means", "equals", "causes",
    "improves", "reduces", "increases", "decreases", "enables", "provides", "is", "are", "was", "were", "has", "have",
]

# What marks an utterance as no claim: greetings, lead of an ad, calls to a page, navigation.
GREETINGS = [
    "my name is", "my name's", "hello", "hi ", "hey ", "hey,", "welcome", "good morning", "good afternoon", "good evening", "thanks for", "thank you for",
    "thanks everyone", "thank you everyone",
]
AD_LEAD = r"^(support for |sponsored by |brought to you by |this (episode|video|podcast|segment) is (sponsored|brought))"
CALLS = ["learn more", "check out", "go to "]
PAGE = r"(https?://|www\.|\.com\b|\.org\b|\.net\b|\.io\b)"
NAVIGATION = "subscribe click visit follow download sign".split()

# The plans of a question with their cues, in order; the words that make a clause a question.
PLANS = [
    ("contradiction", ["contradict", "disagree", "conflict", "inconsistent", "dispute"]),
    ("temporal", ["over time", "change", "evolve", "evolution", "history", "revised", "used to", "originally", "no longer", "these days"]),
    ("procedure", ["how do i", "how to", "steps", "step by step", "install", "set up", "configure", "demo", "walkthrough"]),
    ("visual", ["slide", "diagram", "chart", "graph", "figure", "on screen", "shown", "screenshot", "code on"]),
]
QUESTION_WORDS = "what which who whom whose when where why how".split()
REQUESTS = "explain describe compare list show find summarize give tell what which who when where why how".split()

# Hesitations that captions lose, sounds that they bracket.
HESITATIONS = "um uh erm uhh umm mm hmm mhm uhm ah er".split()
SOUNDS = [
    "music", "applause", "laughs?", "laughter", "laughing", "silence", "inaudible", "noise", "crosstalk", "cheering", "chuckles?", "singing", "humming", "instrumental",
    "sighs?", "groans?", "coughs?", "gasps?", "clears throat", "beep", "static", "whistling", "ticking", "sizzling", "ringing", "rings", "dings?", "bells?", "footsteps",
    "wind", "rain", "thunder",
]

# Words that may stand in a speaker's name, and words before a colon that are no name.
NAME_PARTICLES = "van von de del der da di la le bin al of the y".split()
NO_NAMES = """but and for so well okay ok now yes no oh then also because however i we they he she it this that there here what when why how anyway right note today
look listen wait see first second third next finally warning breaking remember update tip summary conclusion basically honestly actually literally meanwhile again
maybe perhaps alright hey welcome thanks plus""".split()

# Words whose capital at the head of a sentence names nobody; those of CONTENT_STOP but a few belong to them, and these.
_OPENERS = """all both each every some any many much most few several either neither another other such enough more less half he she me him them us my your his her its
our their mine yours ours theirs whatever whoever anyone everyone someone nobody everybody somebody anybody nothing something everything anything first second third
then next finally also however therefore but so if while here there now today tonight tomorrow yesterday yet still even just only once twice again always never often
sometimes usually maybe perhaps probably actually basically honestly literally really truly clearly obviously certainly definitely absolutely anyway anyways besides
instead otherwise meanwhile thus hence moreover furthermore although though because since before after until unless whereas plus whether yes nope yeah yep okay oh ah
uh um hey hi hello wow well sure right look listen see watch wait hold come let like please thanks thank sorry welcome being am done have has had might must get got
want need think know said says say go goes going went make made take took give gave tell told""".split()
_LEADERS = {"of", "to", "as", "by", "with", "from", "will"}
OPENING_CAPITALS = sorted({w.capitalize() for w in [*_OPENERS, *(set(CONTENT_STOP) - _LEADERS)]} | {"OK"})
