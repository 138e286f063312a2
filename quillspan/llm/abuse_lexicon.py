"""The weighted lexicon of abusive, hateful and sexually explicit language: data, not logic.

Terms are general English forms.  A class of terms says little by itself; a pattern names the
classes that, in their order and near each other, make up a case, and its weight: 1 and above is
a case by itself.  Another lexicon of the same form may be given to the scorer.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    #: Class -> terms: words or phrases, lower case, ``|`` between them.
    classes: dict[str, str]
    #: (name, weight, classes in their order, words that may stand between two of them).
    patterns: tuple[tuple[str, float, tuple[str, ...], int], ...]
    #: Phrases in which words of the classes are meant otherwise.
    exceptions: str = ""
    #: Pattern -> fitted weight, in place of its own.
    weights: dict[str, float] = field(default_factory=dict)


# ---- Fixed values: word lists. ----
CLASSES = {
    # nouns that insult whoever they are said of
    "insult": (
        "wanker|wankers|tosser|tossers|twat|twats|bastard|bastards|arsehole|arseholes|asshole|assholes|dickhead|dickheads|shithead|shitheads|prick|pricks|moron|morons|"
        "idiot|idiots|imbecile|imbeciles|cretin|cretins|halfwit|halfwits|scumbag|scumbags|dumbass|dumbasses|dipshit|dipshits|motherfucker|motherfuckers|cunt|cunts|bitch|bitches|"
        "slut|sluts|whore|whores|slag|slags|skank|retard|retards|bellend|bellends|knobhead|knobheads|fuckwit|fuckwits|gobshite|gobshites|nonce|nonces|degenerate|degenerates|"
        "subhuman|subhumans|vermin|arsewipe|arsewipes|shitbag|shitbags|fuckface|dickwad|jackass|jackasses|simpleton|simpletons|lowlife|lowlifes|douchebag|douchebags|"
        "pillock|pillocks|numpty|spastic|spaz|mong|minger|fucktard|knob|knobs|wazzock|shite|scrote|scrotes"
    ),
    # nouns and adjectives that insult beside words that turn on somebody
    "mild noun": (
        "pig|pigs|cow|cows|rat|rats|parasite|parasites|scum|dog|dogs|leech|leeches|worm|worms|clown|clowns|liar|liars|loser|losers|fool|fools|trash|garbage|filth|turd|turds|"
        "maggot|maggots|snake|snakes|toad|weasel|weasels|coward|cowards|pervert|perverts|creep|creeps|freak|freaks|savages|cockroach|cockroaches|hag|troll|trolls|git|gits|muppet|"
        "muppets|dunce|stain|disgrace|failure"
    ),
    "mild": (
        "thick|stupid|dumb|ugly|fat|pathetic|worthless|useless|disgusting|whining|lazy|lying|filthy|brainless|spineless|gutless|clueless|"
        "vile|repulsive|stinking|smelly|braindead|ignorant|slimy|nasty"
    ),
    "you": "you|your|youre|yours|yourself|yourselves|u|ur|ya",
    "they": "he|she|him|her|his|they|them|their|theyre|those|these|whoever|everyone who|anyone who|another|that|the lot of|all of",
    "run": "is run by|are run by|run by|tell that|tell the|tell those|tell this",
    "swear": "fuck|fucking|fucked|fucker|fuckers|fuckin|shit|shitty|bullshit|piss|pissed|arse|bollocks|wank|bugger|crap|bloody|damn",
    "away": (
        "fuck off|fuck you|fuck yourself|piss off|go to hell|rot in hell|burn in hell|drop dead|shut up|shut your|screw you|sod off|bugger off|up yours|eat shit|go die|"
        "crawl back|get back under|kill yourself|hang yourself|top yourself|kys|go hang|off yourself|go fuck|drown yourself|neck yourself"
    ),
    # threats
    "will": "i will|ill|i am going to|im going to|gonna|i would|id|i could|i should|we will|well|we are going to|somebody will|someone will|somebody should|someone should|somebody ought to|i swear|i want to|i wanna|i am coming to|or i|they will|let us|lets|i hope they|i hope someone|i hope somebody",
    "violent": (
        "kill|slit|stab|shoot|punch|slap|kick|beat|smash|break|burn|strangle|choke|drown|hang|gut|slash|rape|batter|crush|throttle|bash|lynch|gas|murder|butcher|skin|"
        "snap|behead|bury|knife|glass|kneecap|destroy|end|hurt|cut|torture|rip|tear|run over|set fire to|string up|wring"
    ),
    "violently": "slapped|shot|hanged|hung|beaten|whipped|flogged|stabbed|kicked|punched|drowned|burned|burnt|strung up|lynched|knocked out|run over|horsewhipped|skinned|kneecapped|put against a wall|strangled",
    "lethal": "kill|killed|shoot|hang|gas|burn|drown|exterminate|slaughter|lynch|butcher|behead|murder|deport|sterilise|castrate|wipe out|put down",
    "everybody": "all of them|them all|every last|the lot of them|every one of them|you all|all of you|those people|their kind|your kind|the bastards",
    "body": "throat|throats|neck|necks|face|faces|head|heads|skull|skulls|leg|legs|finger|fingers|arm|arms|teeth|knees|bones|kneecaps|jaw|nose|house|houses|family|windows|car|guts|stairs|ribs|spine|children",
    "whom": "you|your|him|her|them|their|his|those|these|that lot|the lot|every|all of|whoever|the bastards|ya",
    "fate": "die|rot|choke|suffer|starve|bleed|burn|drown|hang|perish|croak|get cancer|get hit|never wake up|get raped|lose your|lose their|lose his|lose her|loses your|loses their|loses his|loses her",
    "hope": "i hope|love to see|love to watch|hope|hoping|i wish|wish|cannot wait for|cant wait for|pray|please|should|deserve to|deserves to|ought to|just|let|go",
    "lurk": (
        "i know where|we know where|know where you|know where she|know where he|know where they|watch your back|wait for you|waiting for you|be waiting|i will find you|ill find you|we will find you|"
        "coming for you|come for you|you will regret|youll regret|you will pay|youll pay|will be sorry|youll be sorry|sleep with one eye|look over your shoulder|count your days|your days are numbered|"
        "you are dead|youre dead|dead man walking|dead meat|follow you home|following you home"
    ),
    "haunt": "live|lives|park|parks|work|works|sleep|sleeps|drink|drinks|school|home|car park|alley|dark|laughing|sorry|street|shift|tonight",
    # denying somebody's worth
    "waste": (
        "waste of oxygen|waste of space|waste of skin|waste of air|oxygen thief|better off dead|better off without you|better without you|better off without them|better without them|"
        "place without you|cleaner without|safer without|world without you|nobody would miss|no one would miss|noone would miss|would not miss|nobody loves|mistake of nature|"
        "do us all a favour|do everyone a favour|not even human|not human|less than human|barely human|hardly human|ashamed of you|ashamed to have|should have been drowned|"
        "never have been born|aborted|under your stone|under a stone|under your rock|under a rock|under the rock|makes me sick|make me sick|makes me want to vomit|"
        "half a brain|half a mind|no brain|pea brain|pea sized brain|brain of a|iq of|brain cell|brain cells|born stupid|thick as|dumb as|stupid as|ugly as|tie their own|tie your own"
    ),
    "too": "too thick to|too dumb to|too ugly to|too stupid to|too lazy to|too fat to",
    # hatred of groups
    "group": (
        "foreigners|incomers|immigrants|migrants|refugees|outsiders|asylum seekers|newcomers|people like that|people like them|people like you|people of that|that faith|that race|that religion|that accent|that colour|"
        "that kind|their kind|your kind|that sort|their sort|that breed|that lot|your lot|those people|these people|them|they|theyre|all of them|women|females|men like|gays|lesbians|queers|muslims|jews|"
        "christians|hindus|gypsies|travellers|blacks|whites|asians|africans|arabs|chinese|poles|cripples|disabled people|the disabled|the old|old people|the poor|natives|tribes|scroungers|savages|"
        "people|those|anyone with|anyone from|anybody from|everyone from|the lot"
    ),
    "is": "are|is|were|like|nothing but|being|just|all|act like|no better than|as bad as|as|by nature",
    "beast": (
        "vermin|subhuman|animals|apes|monkeys|cockroaches|parasites|scum|plague|inbred|savages|criminals|rapists|thieves|liars|filth|disease|cancer|inferior|inferior race|not people|not human|"
        "less than human|not like us|not one of us"
    ),
    "brute": "breed like|breeding like|by nature|born thieves|born liars|born criminals|born lazy|born stupid|dirty habits|never trust|cannot be trusted|inferior race|on purpose",
    "taint": (
        "spread disease|spreading disease|carry disease|carry diseases|spread diseases|stink|stinks|smell|pollute|infest|infesting|infested|ruin|ruining|invading|invade|swarm|swarming|"
        "overrun|leeching|mouths to feed|taking over|not like us|not people like us|not one of us|filthy|crawled|half a brain"
    ),
    "should": "should be|should all be|must be|must all be|ought to be|need to be|needs to be|deserve to be|deserves to be|want them|have them|get them|should have been|should not be allowed to|should never be allowed to|be safer if|be better if",
    "purge": "sterilised|sterilized|gassed|exterminated|castrated|culled|put down|neutered|euthanised|euthanized|eradicated|wiped out|slaughtered|annihilated|purged|cleansed|rounded up|breed|reproduce|drowned at birth",
    "expel": "deported|locked up|thrown out|kicked out|sent back|driven out|shot|hanged|segregated|burned out|chased out",
    "worse": "or worse|for good|for life|forever|like animals|like dogs|like rats|like pigs",
    "back": "back where they|back to where they|back where you|back to where you|back to where he|back to where she|back where he|back where she|where they crawled|where you crawled|back to your|back to their|back in the sea",
    "keep": "keep|send|throw|kick|get|drive|ship|sling",
    "out": "out of|out|away from|back to|back where",
    "refuse": (
        "no treatment|no medicine|no hospital|no doctor|no help|no beds|no bed|should treat|nobody should treat|refuse to treat|nobody should help|stop treating|not treat|not help|"
        "not let|never let|would not let|wouldnt let|not want|does not want|do not want|nobody wants|near my children|near my child|near our children|near my kids|near our kids|near my daughter|near our daughters"
    ),
    "shun": "let them rot|let em rot|let them die|let them starve|one less|one fewer|near my children|near our children|near my kids|near our kids|near my daughter|not people|animals|thieves|rot|die first|good riddance|like us",
    "none": "no|deny|refuse|stop|cancel|withhold",
    "care": "surgery|surgeries|treatment|treatments|medicine|medicines|operation|operations|doctor|doctors|hospital|nurse|nurses|care|help|bed|beds|transplant|transplants|vaccine|vaccines",
    "only": "the only good|only good thing|good thing about|best thing about|finally some good|at least",
    # sexually explicit language
    "explicit": (
        "blowjob|blowjobs|blow job|blow jobs|handjob|handjobs|my cock|his cock|your cock|big cock|hard cock|thick cock|cocks|dick pic|dick pics|pussy|pussies|tits|titties|tities|horny|cum|cumming|cumshot|deepthroat|threesome|gangbang|creampie|porn|porno|"
        "milf|milfs|dildo|orgy|orgies|masturbate for|masturbating|jerk off|jerking off|fuck me|fuck her|fuck him|fuck my|fucked me|fucked her|fucked him|fucking her|fucking me|suck my|sucked my|sucking my|"
        "suck your|sucked his|lick my|lick your|licked her|ride me|rode his|rode my|ride his|nudes|nude pics|naked pics|dirty pics|naked girls|nude girls|sexy girls|hot girls|sex cam|sex cams|"
        "live sex|amateur sex|anal sex|rough sex|hardcore|xxx|want to fuck|wants to fuck|wanna fuck|hard for you|wet for you|inside her|inside me|moaned|moaning|"
        "bend you over|bending you over|bent her over|bent him over|screw her|screw him|screw me|shag me|shag her|shag you|quick shag|a shag|fancy a shag|boobs|busty|clit|erect cock|hard cock|wet pussy|came inside|both came|stripper|escorts|"
        "big boobs|tight ass|sexy babes|babes|xxx videos|sex tape|sex video|sex videos|filthy videos|dirty videos"
    ),
    "sensual": (
        "cock|knickers|panties|naked|thrust|thrusting|climax|tongue|undressed|nipples|thighs|orgasm|erection|dripping wet|wet|aroused|shag|shagging|uncensored|adults only|strip|strips|stripped|on cam|webcam|sexy|"
        "filthy|on top of me|harder|lust|seduce|pleasure you|touch myself|touching myself|bed with me|his lap|bare breasts|kinky|hot singles|no strings|in bed|sucking|licking|stroking|groped|amateur|bra|girls|moan"
    ),
}

PATTERNS = (
    ("insult", 1.2, ("insult",), 0),
    ("away", 1.1, ("away",), 0),
    ("you mild", 0.7, ("you", "mild"), 4),
    ("you noun", 1.0, ("you", "mild noun"), 5),
    ("noun you", 0.7, ("mild noun", "you"), 1),
    ("mild you", 0.6, ("mild", "you"), 2),
    ("mild mild", 0.6, ("mild", "mild"), 1),
    ("mild noun", 0.6, ("mild", "mild noun"), 1),
    ("they mild", 0.5, ("they", "mild"), 3),
    ("they noun", 0.4, ("they", "mild noun"), 3),
    ("run noun", 1.0, ("run", "mild noun"), 2),
    ("noun away", 0.6, ("mild noun", "away"), 9),
    ("swear", 0.4, ("swear",), 0),
    ("swear you", 0.4, ("swear", "you"), 2),
    ("threat", 1.2, ("will", "violent", "whom"), 4),
    ("violence", 0.8, ("violent", "whom", "body"), 3),
    ("all of them", 1.0, ("lethal", "everybody"), 1),
    ("should be hurt", 1.1, ("should", "violently"), 1),
    ("lurk", 0.7, ("lurk",), 0),
    ("lurk haunt", 0.6, ("lurk", "haunt"), 8),
    ("wish you", 1.1, ("hope", "you", "fate"), 5),
    ("wish they", 1.1, ("hope", "group", "fate"), 4),
    ("waste", 0.8, ("waste",), 0),
    ("waste you", 0.4, ("you", "waste"), 12),
    ("waste they", 0.4, ("they", "waste"), 12),
    ("too", 0.8, ("too",), 0),
    ("too they", 0.4, ("they", "too"), 6),
    ("too group", 0.4, ("group", "too"), 4),
    ("group beast", 0.8, ("group", "is", "beast"), 3),
    ("brute", 0.6, ("brute",), 0),
    ("group brute", 0.5, ("group", "brute"), 5),
    ("brute beast", 0.4, ("brute", "beast"), 0),
    ("group taint", 0.6, ("group", "taint"), 5),
    ("taint taint", 0.5, ("taint", "taint"), 6),
    ("taint group", 0.4, ("taint", "group"), 8),
    ("purge", 1.2, ("should", "purge"), 2),
    ("expel", 0.7, ("should", "expel"), 6),
    ("expel worse", 0.4, ("expel", "worse"), 1),
    ("expel group", 0.6, ("group", "should", "expel"), 8),
    ("back", 1.0, ("back",), 0),
    ("keep out", 0.6, ("keep", "group", "out"), 4),
    ("refuse group", 0.6, ("refuse", "group"), 6),
    ("refuse", 0.3, ("refuse",), 0),
    ("shun", 0.5, ("shun",), 0),
    ("care shun", 0.6, ("none", "care", "shun"), 12),
    ("refuse shun", 0.7, ("refuse", "shun"), 14),
    ("only fate", 1.1, ("only", "fate"), 14),
    ("explicit", 1.1, ("explicit",), 0),
    ("sensual sensual", 0.8, ("sensual", "sensual"), 12),
    ("sensual", 0.3, ("sensual",), 0),
)

EXCEPTIONS = (
    # clinical and official
    "sexually transmitted|sexual health|sex workers|sex worker|sex education|nude mice|stripping of the vein|verbal abuse|racist language|abusive letter|abusive letters|hate crime|hate speech|"
    "painful intercourse|erectile dysfunction|anal cancer|anal cancers|breast cancer|breast screening|breast milk|oral sex is|oral sex and|pornography addiction|climax of|orgasm disorder|orgasmic dysfunction|"
    "female genital|genital warts|self harm|survivors of rape|rape crisis|rape survivors|domestic abuse|inside her uterus|inside her womb|inside me is|growth retard|mental retardation|"
    "non human|not human subjects|not human research|not human tissue|risk of suicide|put down to|put down in|put down the|wiped out by|"
    # friendly
    "damn good|bloody good|bloody marvellous|bloody brilliant|fucking brilliant|fucking marvellous|fucking amazing|fucking love|fucking great|shit hot|lucky bastard|lucky bastards|clever bastard|clever bastards|"
    "poor bastard|poor sod|crazy bastard|crazy bastards|old bastard|you little beauty|"
    # other senses
    "kick the bucket|kick off|kick start|break your leg|break a leg|break the|guinea pig|guinea pigs|lab rats|rats and mice|mice and rats|pig farm|pig farms|pigs and|cash cow|cow s milk|cows milk|weather cock|"
    "cock and bull|cock crow|stop cock|great tits|blue tits|blue tit|great tit|coal tits|long tailed tits|fool proof|foolproof|dog bite|dog bites|hook worm|ring worm|fat intake|saturated fat|low fat|body fat|"
    "fat content|stray dogs|guide dogs|assistance dogs|pin prick|finger prick|heel prick|skin prick|prick test|prick tests|prick the|prick out|prick up|pricks the|prick your finger|pussy cat|pussy willow|shag pile|shag carpet|"
    "suffer no|suffer any|suffer from|suffers from|that is stupid|that was stupid|door knob|door knobs|knob of butter|knobs of butter|bitch and her|slag heap|slag heaps|nonce word|number used once|gas them up|choke point|hang up|hang on|beat them at|beat them to|beat you to|"
    "end your|end their|end his|end her|end them|end all of|break their|cut your|cut their|cut them|shoot you an email|shoot them an email|kill your|kill the process|kill them softly|cut all of|end those|end these|break them|break those|break these|cut those|cut these|beat those|beat these|skin your|skin their|skin his|skin her|"
    "head over|face to face|hurt their|hurt your|hurt his|hurt her feelings|burn those calories|punch your ticket|bash your|tear your|tear their|rip your|glass of|glass in"
)

DEFAULT = Lexicon(CLASSES, PATTERNS, EXCEPTIONS)
