"""The stemmer against the sample words published with it."""

from corpusforge.functions.stem import stems

SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes
inning inning innings inning outing outing cannings canning herring herring earrings earring proceed proceed exceed exceed succeed succeed
generate generat general general generic generic generically generic communal communal commune commune community communiti arsenal arsenal arsenic arsenic
ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri cry cri by by say say happy happi agreed agre feed feed sized size
relational relat conditional condit rational ration valency valenc hesitancy hesit digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl
triplicate triplic formative format formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll chunks chunk chunking chunk yes yes youth youth boyish boyish""".split()


def test_published_words(spark):
    want = dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    got = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in want], "term string")).collect()}
    assert got == want


def test_odd_words(spark):
    rows = [("'quoted", "quot"), ("dog's", "dog"), ("", ""), ("a", "a"), ("naïveté", "naïveté"), ("2005", "2005"), ("x_y-z", "x_y-z"), (None, None)]
    assert {(r.term, r.stem) for r in stems(spark.createDataFrame([(w,) for w, _ in rows], "term string")).collect()} == set(rows)
    assert stems(spark.createDataFrame([], "term string")).count() == 0
