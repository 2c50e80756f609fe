"""Word lists that the measures are defined by."""

# Function words of the summary measures.
SUMMARY_STOPS = frozenset(
    """a an the is are was were be been being have has had do does did will would shall should may might can could of in to for on
    with at by from as into through during before after above below between out off over under again further then once here there
    when where why how all both each few more most other some such no nor not only own same so than too very and but if or because
    until while about against it its he she they them his her this that these those i me my we our you your who whom which
    what""".split()
)

# Function words of the translation measures.
TRANSLATION_STOPS = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might shall can to of in on at
    by for with from as it its this that these those and or but not so if then than when where which who what how all each every
    both few more most i we you he she they me us him her them my our your his their its about up out into just also very
    such""".split()
)

# Function words left out of the coverage of a prompt.
COVERAGE_STOPS = frozenset(
    """a an the is are was were be been being have has had do does did will would shall should may might can could and but or nor
    for so yet at by to from in on with as of""".split()
)

# Function words left out of the repetition of words.
REPETITION_STOPS = COVERAGE_STOPS | frozenset("it its i me my we our you your he she they them their this that these those".split())

#: Function words left out of term vectors, a parameter of the measures: the lists above together.
VECTOR_STOPS = SUMMARY_STOPS | TRANSLATION_STOPS | REPETITION_STOPS

# Words of positive sentiment.
POSITIVE = frozenset(
    """good great excellent wonderful fantastic amazing outstanding superb brilliant perfect beautiful delightful exceptional
    magnificent marvelous spectacular terrific fabulous incredible awesome remarkable impressive splendid wonderful happy pleased
    glad satisfied grateful thankful hopeful optimistic confident excited enthusiastic eager passionate inspired motivated
    encouraged proud successful effective efficient productive beneficial valuable helpful useful important significant meaningful
    substantial considerable noteworthy creative innovative inventive resourceful talented skilled competent capable reliable
    trustworthy dependable consistent dedicated committed devoted loyal friendly warm kind generous compassionate caring
    supportive understanding""".split()
)

# Words of negative sentiment.
NEGATIVE = frozenset(
    """bad terrible awful horrible dreadful appalling atrocious deplorable disastrous poor weak inadequate insufficient
    unsatisfactory disappointing mediocre sad unhappy depressed miserable sorrowful gloomy dismal distressed troubled angry
    furious enraged hostile aggressive confrontational accusatory harsh difficult problematic challenging troublesome complicated
    complex confusing dangerous hazardous risky threatening harmful destructive damaging detrimental ugly unpleasant disagreeable
    offensive repulsive revolting disgusting failed unsuccessful ineffective inefficient wasteful useless pointless unreliable
    undependable inconsistent careless negligent irresponsible rude impolite disrespectful inconsiderate insensitive thoughtless
    unkind worried anxious nervous fearful scared frightened concerned alarmed broken damaged flawed defective faulty imperfect
    incomplete missing urgent desperate critical severe extreme excessive overwhelming unbearable""".split()
)

# Words of opinion.
SUBJECTIVE = frozenset(
    """think believe feel opinion personally seems appears likely probably perhaps maybe possibly somewhat rather quite fairly
    pretty actually honestly frankly truly genuinely certainly definitely absolutely obviously clearly evidently apparently
    supposedly presumably best worst better worse favorite preferred recommended love hate prefer enjoy dislike appreciate value
    admire beautiful ugly amazing terrible wonderful horrible fantastic awful interesting boring exciting dull fascinating tedious
    remarkable ordinary important trivial significant meaningless crucial unnecessary essential easy difficult simple complicated
    straightforward confusing""".split()
)

# Words of formal style.
FORMAL = frozenset(
    """therefore furthermore moreover consequently subsequently accordingly hence nevertheless nonetheless notwithstanding albeit
    whereas whilst pursuant herein therein thereof whereby wherein henceforth shall endeavor facilitate implement utilize commence
    terminate regarding concerning pertaining respective aforementioned acknowledge ascertain constitute demonstrate exemplify
    substantiate corroborate elucidate delineate articulate comprehensive preliminary subsequent supplementary""".split()
)

# Words of informal style.
INFORMAL = frozenset(
    """gonna wanna gotta kinda sorta yeah nah yep nope ok okay hey hi hello guys stuff things lot lots pretty really very awesome
    cool nice great sweet sick dope lit can't won't don't isn't aren't wasn't weren't hasn't haven't shouldn't wouldn't couldn't
    wouldn't i'm you're we're they're it's that's what's who's where's there's here's btw fyi asap lol omg tbh imo imho
    fwiw""".split()
)

# Words of transition, each looked for anywhere in a text, inside other words too.
TRANSITION = frozenset(
    """however therefore furthermore moreover additionally consequently subsequently accordingly nevertheless nonetheless meanwhile
    specifically particularly notably significantly importantly similarly likewise conversely alternatively comparatively firstly
    secondly thirdly finally ultimately eventually in addition in contrast in conclusion in summary for example for instance as a
    result on the other hand in particular to begin with in other words that said above all after all""".split()
)

# Verbs of content of at most five letters (words of more letters count as content by their length).
SHORT_VERBS = frozenset(
    """adapt align apply build draft drive edit guide link map merge model parse plan query serve solve test track train
    write yield""".split()
)

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Mr Mrs Ms Dr Prof Sr Jr vs etc Inc Ltd Corp dept approx i.e e.g a.m p.m Fig No Vol Rev Gen Gov Sgt Cpl Pvt Capt Lt Col Maj Brig Est"
    " Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec"
).split()
