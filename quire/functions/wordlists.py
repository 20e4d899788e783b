"""Closed word classes and the like, which results depend on."""

# fixed values: function words of written English
FUNCTION_WORDS = (
    "the of and to in a is that it for was as with be by on not he i this are or "
    "his from at which but have an they you one had word all were we when your can "
    "said there use each she do how their if will up other about out many then them "
    "these so some her would make like him into time has look two more write go see "
    "no way could my than been who its now did get may down way came should because "
    "does most us am is are was were be been being have has had having do does did "
    "doing shall will would can could may might must ought need dare "
    "i me my mine myself you your yours yourself he him his himself she her hers "
    "herself it its itself we us our ours ourselves they them their theirs themselves "
    "who whom whose which what that this these those such same other another any "
    "some none both either neither each every all few several many much more most "
    "less least own "
    "in on at by for with from to into onto upon about above across after against "
    "along among around before behind below beneath beside besides between beyond "
    "during except inside near of off out outside over past since through throughout "
    "toward towards under underneath until up upon within without despite per via "
    "and or but nor yet so although though because if unless while whereas whether "
    "since when where how why than as "
    "not no nor only just even still also too very rather quite indeed however "
    "therefore thus hence moreover furthermore nevertheless nonetheless otherwise "
    "there here then once again always never often sometimes usually perhaps "
    "a an the"
).split()

# fixed values: word classes of the tagger
DETERMINERS = (
    "the a an this that these those its his her their our my your any no each every some such "
    "one another which whose both all either neither"
).split()
VERB_CUES = "to will would can could may might must shall should do does did not cannot let help must".split()
SUBJECT_PRONOUNS = "i we you they who people scholars states".split()
PREPOSITIONS = "of in on at by for with from into onto upon about over under between among through against without within during toward towards across".split()

# fixed values: words before a period that does not end a sentence
ABBREVIATIONS = (
    "vol vols no nos ed eds ch chap chaps fig figs tab tabs pp esp vs mr mrs ms dr prof st jr sr rev trans repr sec secs nn "
    "cit ff inc dept univ co corp et al cf"
).split()

# fixed values: noun and verb readings of words that are spelled alike, and readings that need no tag
HOMOGRAPHS = {
    "record": ("ɹˈɛkɚd", "ɹɪkˈɔɹd"),
    "conflict": ("kˈɑnflɪkt", "kənflˈɪkt"),
    "present": ("pɹˈɛzənt", "pɹɪzˈɛnt"),
    "subject": ("sˈʌbʤɛkt", "səbʤˈɛkt"),
    "contract": ("kˈɑntɹækt", "kəntɹˈækt"),
    "object": ("ˈɑbʤɛkt", "əbʤˈɛkt"),
    "project": ("pɹˈɑʤɛkt", "pɹəʤˈɛkt"),
    "conduct": ("kˈɑndʌkt", "kəndˈʌkt"),
    "contest": ("kˈɑntɛst", "kəntˈɛst"),
    "contrast": ("kˈɑntɹæst", "kəntɹˈæst"),
    "convert": ("kˈɑnvɜɹt", "kənvˈɜɹt"),
    "increase": ("ˈɪnkɹis", "ɪnkɹˈis"),
    "decrease": ("dˈikɹis", "dɪkɹˈis"),
    "permit": ("pˈɜɹmɪt", "pɚmˈɪt"),
    "rebel": ("ɹˈɛbəl", "ɹɪbˈɛl"),
    "protest": ("pɹˈoʊtɛst", "pɹətˈɛst"),
    "progress": ("pɹˈɑɡɹɛs", "pɹəɡɹˈɛs"),
    "produce": ("pɹˈoʊdus", "pɹədˈus"),
    "address": ("ˈædɹɛs", "ədɹˈɛs"),
    "transfer": ("tɹˈænsfɜɹ", "tɹænsfˈɜɹ"),
    "export": ("ˈɛkspɔɹt", "ɪkspˈɔɹt"),
    "import": ("ˈɪmpɔɹt", "ɪmpˈɔɹt"),
    "suspect": ("sˈʌspɛkt", "səspˈɛkt"),
    "survey": ("sˈɜɹveɪ", "sɚvˈeɪ"),
    "refuse": ("ɹˈɛfjus", "ɹɪfjˈuz"),
    "separate": ("sˈɛpɚɪt", "sˈɛpɚeɪt"),
    "delegate": ("dˈɛlɪɡɪt", "dˈɛlɪɡeɪt"),
    "estimate": ("ˈɛstɪmɪt", "ˈɛstɪmeɪt"),
    "moderate": ("mˈɑdɚɪt", "mˈɑdɚeɪt"),
    "associate": ("əsˈoʊʃiɪt", "əsˈoʊʃieɪt"),
    "deliberate": ("dɪlˈɪbɚɪt", "dɪlˈɪbɚeɪt"),
    "alternate": ("ˈɔltɚnɪt", "ˈɔltɚneɪt"),
    "appropriate": ("əpɹˈoʊpɹiɪt", "əpɹˈoʊpɹieɪt"),
    "advocate": ("ˈædvəkɪt", "ˈædvəkeɪt"),
    "aggregate": ("ˈæɡɹɪɡɪt", "ˈæɡɹɪɡeɪt"),
    "elaborate": ("ɪlˈæbɚɪt", "ɪlˈæbɚeɪt"),
    "articulate": ("ɑɹtˈɪkjəlɪt", "ɑɹtˈɪkjəleɪt"),
}
UNCONDITIONAL = {"lead": "lˈid", "leads": "lˈidz", "read": "ɹˈid", "reads": "ɹˈidz"}

# fixed values: relative length of the symbols of a class, in frames
SYMBOL_WEIGHTS = (
    ("ɑɐɒæɔɜɝeioua", 5.0),
    ("ɪʊɛʌəɚᵻɘɞøɵœ", 3.0),
    ("ptkbdɡɢqʔʡ", 2.5),
    ("ʧʤ", 4.0),
    ("fvθðszʃʒhçxɣβɸʜʢħʕχʝɧ", 4.0),
    ("mnŋɱɲɴ", 3.0),
    ("lɹrjwɫɭʎʟɾɽɺʀʁɻʋɥʍɰ", 3.0),
    ("ˈˌʼʴʰʱʲʷˠˤ˞↓↑→↗↘", 1.0),
    ("ːˑ", 2.0),
    (" ", 2.0),
    (".!?…", 10.0),
    (",;:—", 6.0),
    ("$", 1.0),
)
OTHER_WEIGHT = 1.5
