"""Fixed values.

Everything in this module is a value that must equal a published constant
for results to be right.  The lists are written out plainly, in their
natural order, and nothing else in the package re-derives them.
"""

# --- fixed values: cleaning patterns of the preprocessing step ------------
URL_PATTERN = r"https?://[^\s\n\r]+"
HASH_SIGN_PATTERN = "#"
NUMBER_PATTERN = r"\d+"

# --- fixed values: the 32 ASCII punctuation signs (Python string.punctuation)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: the English stop-word list of the NLTK corpus (179 words)
STOPWORDS_EN = (
    "i me my myself we our ours ourselves you you're you've you'll you'd "
    "your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which "
    "who whom this that that'll these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t "
    "can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# --- fixed values: split and search seeds / sizes --------------------------
SHUFFLE_SEED = 12          # seed of the row shuffle before the 80/20 split
SEARCH_SEED = 42           # seed of the randomised searches
TEST_BUCKETS = 5           # one bucket of five is the test split (20 %)
N_FOLDS = 5
TFIDF_MAX_FEATURES = 5000
LR_C_GRID = [10.0 ** (-4 + 8 * i / 9) for i in range(10)]   # logspace(-4, 4, 10)
MNB_ALPHA_GRID = [0.1, 0.5, 1.0]
MNB_ALPHA_LOW, MNB_ALPHA_HIGH, MNB_LOG_DRAWS = 0.01, 1.0, 30
SVM_C_LOW, SVM_C_HIGH = 0.1, 100.1          # uniform(0.1, 100) means [0.1, 100.1]
SVM_GAMMA_LOW, SVM_GAMMA_HIGH = 0.001, 1.001
SVM_DRAWS = 20
RF_TREES = [50, 100, 200, 500]
RF_DEPTHS = [10, 20, 30, 50]
RF_MIN_SPLIT = [2, 5, 10]
RF_CRITERIA = ["gini", "entropy"]
RF_DRAWS = 50
GBT_ROUNDS = (100, 499)
GBT_DEPTH = (3, 9)
GBT_RATE = (0.01, 0.30)
GBT_SUBSAMPLE = (0.5, 1.0)
GBT_COLSAMPLE = (0.5, 1.0)
GBT_CHILD_WEIGHT = (1, 9)
GBT_GAMMA = (0.0, 5.0)
GBT_DRAWS = 50
HOLDOUT_SVM_C = (1e-3, 1e3)
HOLDOUT_SVM_GAMMA = (1e-4, 1e-1)
HOLDOUT_SVM_DRAWS = 10
HOLDOUT_RF_DRAWS = 5
HOLDOUT_RF_TREES = (50, 299)        # upper ends of the integer ranges are exclusive
HOLDOUT_RF_DEPTH = (5, 29)
HOLDOUT_RF_MIN_SPLIT = (2, 9)
HOLDOUT_RF_FEATURES = ["sqrt", "log2"]
TRUNCATE_TOKENS = 512
BATCH_WORDS = 5000         # words of the default batch model
BATCH_SCALE = 4.0
SCORE_BATCH_SIZE = 256

# --- fixed values: retrieval ------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
TOP_K = 3
SAMPLE_N = 100
EMBED_DIMS = 64

# --- fixed values: valence scoring constants (Hutto & Gilbert, ICWSM 2014) --
VALENCE_ALPHA = 15.0          # compound = s / sqrt(s*s + alpha)
BOOST_INCREMENT = 0.293       # intensifier adds this much
BOOST_DECREMENT = -0.293      # dampener subtracts this much
CAPS_INCREMENT = 0.733        # ALL-CAPS word in mixed-case text
NEGATION_SCALAR = -0.74       # valence multiplier after a negation
BUT_BEFORE = 0.5              # valence weight before "but"
BUT_AFTER = 1.5               # valence weight after "but"
DISTANCE_DAMPING = [1.0, 0.95, 0.9]   # modifier 1, 2, 3 words back
EXCLAMATION_STEP = 0.292      # per "!" up to four
QUESTION_STEP = 0.18          # per "?" for two or three
QUESTION_MAX = 0.96           # more than three "?"
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt "
    "ain't aren't can't couldn't daren't didn't doesn't "
    "dont hadnt hasnt havent isnt mightnt mustnt neither "
    "don't hadn't hasn't haven't isn't mightn't mustn't "
    "neednt needn't never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh wasnt werent "
    "oughtn't shan't shouldn't uh-uh wasn't weren't "
    "without wont wouldnt won't wouldn't rarely seldom despite"
).split()
BOOSTERS_UP = (
    "absolutely amazingly awfully completely considerable considerably "
    "decidedly deeply effing enormous enormously entirely especially "
    "exceptional exceptionally extreme extremely fabulously flipping flippin "
    "frackin fracking fricking frickin frigging friggin fully fuckin fucking "
    "fuggin fugging greatly hella highly hugely incredible incredibly "
    "intensely major majorly more most particularly purely quite really "
    "remarkably so substantially thoroughly total totally tremendous "
    "tremendously uber unbelievably unusually utter utterly very"
).split()
BOOSTERS_DOWN = (
    "almost,barely,hardly,just enough,kind of,kinda,kindof,kind-of,less,"
    "little,marginal,marginally,occasional,occasionally,partly,scarce,"
    "scarcely,slight,slightly,somewhat,sort of,sorta,sortof,sort-of"
).split(",")
CONTRAST_WORD = "but"
IDIOMS = {                    # word sequences with a valence of their own
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0}
NEVER_SO = 1.5                # "never so", "never this" right before a word
NEVER_SO_FAR = 1.25           # the same one word farther off
LEAST_AFTER = ("at", "very")  # "at least", "very least" don't negate
LEXICON_CLIP = 4.0            # induced valences are clipped to [-4, 4]
LEXICON_MIN_COUNT = 5         # minimum token frequency for an induced valence
PHRASE_WORDS = (2, 3)         # words of an induced phrase
