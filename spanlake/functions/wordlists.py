"""Word lists that results depend on."""

# Common English words dropped from keyword queries.
QUERY_STOP_WORDS = (
    "a an the is are s was were be been being have has had do does did will would could should "
    "may might shall can of in to for with on at by from about as into through during before "
    "after above below between and but or nor not so yet both either neither this that these those "
    "it its he she they we you i me my his her their our your"
).split()

# Discourse filler dropped from draft sentences in addition to the stop words.
FILLER_WORDS = (
    "really very just actually basically maybe perhaps think know like want wanted going get getting "
    "got thing things kind sort lot stuff way make makes made said say says also much many more most some "
    "then than when where what which who why how there here now well one even"
).split()

# Words never used as a label keyword.
LABEL_STOP_WORDS = (
    "the and that have for not with you this but his from they she her been "
    "than its who what when where which will would there their them then "
    "these those your are was were has had did does doing done being "
    "about above after again against all any because before below between "
    "both down during each few more most other some such only own same "
    "too very can just should now also into out off over under here how why "
    "our ours yourself yourselves himself herself itself themselves "
    "could might must shall may "
    "yeah okay like really kind sort thing things going know think said say "
    "says gonna wanna got get getting one two three lot bit way"
).split()

# Suffix of a suggestion label by rank.
SUGGESTION_SUFFIXES = ["evidence", "context", "supporting detail", "related passage", "background"]

# Sub-theme names by cluster index.
THEME_NAMES = ["key evidence", "emotional context", "counterpoint", "background"]

# Transcript file extensions.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "text"]

# End marks of a reasoning block in a model reply.
REASONING_MARKS = ["</think>", "<|message|>", "<|message>", "<|end_of_thought|>"]

# Page sizes a caller can ask for.
PAGE_SIZES = [12, 25, 50, 100]
