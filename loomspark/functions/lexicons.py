"""Word lists and patterns. All of them are defaults: every operator takes its lists as arguments.

Fixed values: the lists below are the ones the analytics are defined by, stated as text.
"""

# ruff: noqa: E501
from __future__ import annotations

import re

STOP_WORDS = (
    "i me my we you your he she it they the a an is are was were be been have has had do does did will would could should"
    " can may might shall to of in for on with at by from as into through during before after and but or not so if than too"
    " very just about that this what how when where who why all each every both few more most some any other there here also"
    " like know think really yeah yes okay well good great nice love sounds thanks thank much lot going get got make made way"
    " time one two thing things sure right back still never always pretty something someone anything try come want even"
).split()
CONTENT_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for"
    " on with at by from up about into through during before after and but or so if than that this these those i me my you"
    " your he she it we they them his her its our their what which who when where why how"
).split()
RERANK_STOP_WORDS = "the what how does are they their this that about who which when where can will has have had was were been being with".split()
ENTITY_STOP_WORDS = (
    "did i my me you the a an is are was were have has had do does about anything something mention mentioned say said tell"
    " told any ever there what how when where who which that this with for from"
).split()
ENTITY_NOT = ("it", "that", "this", "i", "me")
ENTITY_WORDS = (
    "sister brother mom mother dad father wife husband partner friend boss colleague dog cat pet car house job school doctor"
    " teacher neighbor cousin uncle aunt grandmother grandfather boyfriend girlfriend roommate coworker baby child children"
).split()
ENTITY_PATTERNS = (
    r"(?:about|mention|said about|regarding|related to)\s+(?:my\s+)?(\w+(?:\s+\w+)?)",
    r"(?:my|the)\s+(\w+)",
    r"(?:did i|have i|was there)\s+\w+\s+(?:about|regarding)\s+(?:my\s+)?(\w+)",
)
FACT_CUES = ("i am", "i'm", "i work", "i have", "i love", "i like", "i enjoy", "my favorite", "i live", "i play", "i study", "i used to")
CHECKPOINT_FACT_CUES = FACT_CUES[:-1]
NAME_PATTERNS = (
    r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)+)\b",
    r"(?:named?|called?)\s+(\w+)",
    r"(?:in|to|from)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)",
)
NAME_NOT = ("the", "and", "for", "that", "this", "user")

HABIT_PATTERNS = {
    "food_preference": (
        r"(?:i (?:love|like|enjoy) (?:eating|cooking|making))\s+(.*?)(?:\.|!|$)",
        r"my favorite (?:food|meal|dish) is\s+(.*?)(?:\.|!|$)",
        r"i (?:always|usually|often) (?:eat|cook|make)\s+(.*?)(?:\.|!|$)",
        r"i'm (?:a )?(?:vegan|vegetarian|pescatarian)",
        r"i (?:love|like|enjoy)\s+(?:cooking|baking)",
    ),
    "exercise_habit": (
        r"i (?:love to|like to|enjoy)?\s*(?:run|jog|hike|swim|bike|cycle|workout|work out|exercise|yoga|lift)",
        r"i (?:go|do)\s+(?:running|jogging|hiking|swimming|biking|cycling|yoga|pilates)",
        r"i (?:play|practice)\s+(?:soccer|football|basketball|tennis|golf|baseball)",
        r"i (?:usually|always|often)\s+(?:work out|exercise|run|jog)",
    ),
    "sleep_pattern": (
        r"i (?:usually|always|tend to)\s+(?:stay up|sleep|wake up|get up)\s+(.*?)(?:\.|!|$)",
        r"i'm (?:a )?(?:night owl|early bird|morning person|late sleeper|early riser)",
        r"i (?:go to bed|fall asleep)\s+(.*?)(?:\.|!|$)",
    ),
    "daily_routine": (
        r"(?:every|each)\s+(?:morning|evening|night|day)\s+i\s+(.*?)(?:\.|!|$)",
        r"i (?:usually|always|often)\s+(?:start|begin|end)\s+my day\s+(.*?)(?:\.|!|$)",
        r"my (?:morning|evening|daily|night)\s+routine\s+(.*?)(?:\.|!|$)",
    ),
    "hobby": (
        r"i (?:love|like|enjoy)\s+(?:to\s+)?(?:read|paint|draw|write|garden|fish|cook|bake|sing|dance|play|collect)",
        r"my hobbies?\s+(?:is|are|include)\s+(.*?)(?:\.|!|$)",
        r"in my (?:spare|free) time\s+i\s+(.*?)(?:\.|!|$)",
        r"i (?:love|like|enjoy)\s+(.*?)(?:\.|!|$)",
    ),
}
#: The endings of an occupation, in the order and with the repeats of the pattern they make; every one of them is a job title.
OCCUPATIONS = (
    "engineer|doctor|nurse|teacher|student|developer|designer|manager|chef|firefighter|librarian|barista|programmer|artist|musician|writer"
    "|photographer|lawyer|accountant|scientist|researcher|analyst|consultant|pilot|driver|mechanic|electrician|plumber|carpenter|farmer"
    "|fisherman|soldier|police|officer|detective|agent|clerk|secretary|receptionist|cashier|waiter|waitress|cook|baker|butcher|grocer"
    "|pharmacist|dentist|surgeon|therapist|counselor|psychologist|psychiatrist|professor|instructor|tutor|coach|trainer|mentor|intern"
    "|apprentice|volunteer|freelancer|entrepreneur|founder|owner|director|president|ceo|cto|cfo|vp|manager|supervisor|coordinator"
    "|administrator|assistant|associate|specialist|expert|consultant|advisor|strategist|architect|designer|developer|programmer|coder"
    "|tester|analyst|data|software|hardware|network|system|security|cloud|devops|fullstack|frontend|backend|mobile|web|game|ai|ml|data"
    "|science|research|ux|ui|product|project|program|sales|marketing|business|finance|accounting|hr|legal|operations|logistics|supply|chain"
    "|customer|service|support|technical|quality|compliance|audit|risk|insurance|banking|investment|real estate|hospitality|tourism|travel"
    "|retail|wholesale|manufacturing|construction|mining|agriculture|forestry|fishing|energy|utility|telecom|media|entertainment|publishing"
    "|education|health|medical|pharmaceutical|biotech|nonprofit|government|military|religious|social|community|environmental"
)
FACT_PATTERNS = {
    "occupation": (
        rf"i(?:'m| am) (?:a |an )?(.*?(?:{OCCUPATIONS}))",
        r"i work (?:as|at|for|in)\s+(.*?)(?:\.|!|$)",
        r"my job is\s+(.*?)(?:\.|!|$)",
        r"i'm (?:a )?(?:fulltime|full-time|part-time|parttime) (?:student|worker|employee)",
        r"i (?:study|studying|studied)\s+(.*?)(?:\.|!|$)",
    ),
    "relationship": (
        r"my (?:husband|wife|partner|boyfriend|girlfriend|spouse|fiance|fiancee)\s+(.*?)(?:\.|!|$)",
        r"i'm (?:married|engaged|single|divorced|separated|dating|in a relationship)",
        r"i have (?:a |)(?:son|daughter|kids|children|child|baby|twin)",
        r"i'm (?:a )?(?:single )?(?:mom|dad|parent|mother|father)",
        r"my (?:family|parents|siblings|brothers?|sisters?|mom|dad|mother|father)",
    ),
    "pet": (
        r"i have (?:a |an |)(?:dog|cat|pet|fish|bird|hamster|rabbit|guinea pig|turtle|snake|lizard|parrot|ferret|horse|pony)",
        r"my (?:dog|cat|pet)(?:'s name)? is\s+(.*?)(?:\.|!|$)",
        r"(?:dog|cat|pet) named\s+(\w+)",
    ),
    "location": (
        r"i (?:live|moved|moving|relocated)\s+(?:in|to|from)\s+(.*?)(?:\.|!|$)",
        r"i'm (?:from|originally from|based in)\s+(.*?)(?:\.|!|$)",
        r"i (?:grew up|was born|was raised)\s+(?:in|near)\s+(.*?)(?:\.|!|$)",
    ),
    "age_education": (
        r"i'm\s+(\d+)\s+years?\s+old",
        r"i (?:graduated|went to|attend|go to)\s+(.*?)(?:\.|!|$)",
        r"i'm in (?:high school|college|university|grad school|graduate school)",
    ),
    "vehicle": (
        r"i (?:have|own|drive)\s+(?:a |an )?(.*?(?:car|truck|motorcycle|bike|impala|mustang|camaro|corvette|tesla|bmw|audi|mercedes|honda|toyota|ford|chevy|dodge|jeep).*?)(?:\.|!|$)",
    ),
}
TRAITS = {
    "enthusiastic": ("awesome", "amazing", "incredible", "fantastic", "wonderful", "love", "excited", "thrilled", "wow", "cool", "great"),
    "empathetic": ("sorry", "understand", "feel", "hope", "care", "miss", "wish", "support", "help", "glad"),
    "humorous": ("haha", "lol", "funny", "joke", "laugh", "hilarious", "lmao", "rofl"),
    "friendly": ("friend", "together", "fun", "enjoy", "share", "welcome", "nice to meet", "pleasure"),
    "curious": ("tell me", "what about", "how about", "interested", "wondering", "curious", "what kind", "what type"),
    "supportive": ("good for you", "that's great", "proud", "happy for", "good luck", "you can", "believe in"),
    "adventurous": ("travel", "explore", "adventure", "new places", "road trip", "discover", "experience"),
    "introverted": ("alone", "quiet", "peace", "calm", "relax", "by myself", "introvert", "homebody"),
    "family_oriented": ("family", "kids", "children", "parents", "siblings", "home", "together"),
    "creative": ("art", "create", "design", "paint", "draw", "write", "music", "craft", "build"),
}
FORMAL_WORDS = ("indeed", "furthermore", "however", "therefore", "nevertheless", "consequently", "additionally", "moreover", "regarding", "concerning")
INFORMAL_WORDS = ("yeah", "yep", "nah", "gonna", "wanna", "gotta", "kinda", "sorta", "lol", "omg", "tbh", "imo", "brb", "btw")
GREETINGS = ("hi", "hello", "hey", "good morning")
#: category: (cues, most messages kept)
EVIDENCE = {
    "personal_info": (("i am", "i'm", "i work", "i have", "i live"), 20),
    "hobbies_interests": (("i love", "i like", "i enjoy", "hobby", "fun", "spare time", "free time"), 20),
    "emotional_expression": (("feel", "happy", "sad", "excited", "worried", "scared", "miss", "love"), 15),
}
PERSONA_CUES = (
    "person", "personality", "kind of person", "type of person", "habits", "habit", "style", "talk", "communicate", "behave", "traits",
    "trait", "character", "who is", "what is user", "how do they", "how does", "what are their", "persona", "describe",
    "like as a person", "emoji", "tone", "mood", "interests", "hobbies", "hobby", "relationship", "job", "occupation", "work", "pet",
    "animal", "live", "from", "food", "eat", "sleep", "exercise", "routine", "daily", "fun", "free time", "spare time",
)
MOOD_DIMS = ("valence", "intensity", "frustration", "playfulness", "formality", "curiosity", "emoji_rate", "avg_length")
MOOD_PROTOTYPES = {
    "curious": {"curiosity": 0.8, "valence": 0.3, "playfulness": 0.2},
    "formal": {"formality": 0.8, "avg_length": 0.6, "curiosity": 0.3},
    "casual": {"formality": -0.8, "playfulness": 0.4, "emoji_rate": 0.4},
    "frustrated": {"frustration": 0.7, "valence": -0.5, "intensity": 0.6},
    "playful": {"playfulness": 0.8, "emoji_rate": 0.5, "valence": 0.4},
    "enthusiastic": {"valence": 0.8, "intensity": 0.7, "playfulness": 0.3},
    "reserved": {"formality": 0.5, "avg_length": -0.4, "intensity": -0.3},
    "anxious": {"frustration": 0.4, "intensity": 0.6, "valence": -0.3, "curiosity": 0.3},
    "warm": {"valence": 0.6, "intensity": 0.4, "playfulness": 0.3, "emoji_rate": 0.3},
    "neutral": {"valence": 0.0, "intensity": -0.3, "formality": 0.1},
}
EVENTS = {
    "exam": ("exam", "test", "midterm", "final", "quiz", "assessment"),
    "interview": ("interview", "job interview", "hiring", "recruiter"),
    "trip": ("trip", "travel", "vacation", "holiday", "flight", "visit"),
    "birthday": ("birthday", "bday", "party", "celebration", "celebrate"),
    "deadline": ("deadline", "due date", "due tomorrow", "submission"),
    "breakup": ("breakup", "broke up", "break up", "ended things", "split"),
    "argument": ("argument", "fight", "argued", "disagreement", "heated"),
    "health": ("sick", "doctor", "hospital", "ill", "surgery", "injured"),
    "graduation": ("graduated", "graduation", "degree", "diploma"),
    "moving": ("moving", "moved", "relocating", "new apartment", "new house"),
    "promotion": ("promoted", "promotion", "raise", "new position"),
    "loss": ("lost", "passed away", "died", "funeral", "grief", "mourning"),
}
HUMOR = ("lol", "lmao", "rofl", "haha", "hehe", "😂", "🤣", "😆", "lolol", "xd", "hahaha", "lmfao", "😜", "😝", "🤪")
STRESS = (
    "stressed", "angry", "furious", "annoyed", "irritated", "fed up", "frustrated", "overwhelmed", "exhausted", "burned out", "burnt out",
    "anxious", "worried", "nervous", "freaking out", "can't take", "sick of", "tired of", "pissed", "ugh", "argh", "damn", "hate",
    "terrible", "awful", "horrible", "miserable", "struggling",
)
SLANG = (
    "gonna wanna gotta kinda sorta ya nah lol omg tbh imo brb btw idk ikr ngl rn smh nvm imho af irl fomo fyi tho thx u ur r plz pls"
).split()
PERSON_PATTERNS = (
    r"\bmy\s+(sister|brother|mom|mother|dad|father|wife|husband|partner|boyfriend|girlfriend|friend|boss|colleague|coworker|neighbor|uncle|aunt|cousin|grandma|grandmother|grandpa|grandfather|roommate|fiancee?|ex)\b",
    r"\b(sister|brother|mom|mother|dad|father)\s+(?:said|told|called|texted|asked|wants)\b",
)
NEGATIONS = (
    "not no never neither nobody nothing nowhere nor can't cannot couldn't won't wouldn't shouldn't isn't aren't wasn't weren't don't"
    " doesn't didn't hasn't haven't hadn't"
).split()
OPPOSITES = (
    ("coming", "cancelled"), ("visit", "cancelled"), ("excited", "disappointed"), ("happy", "sad"), ("love", "hate"), ("together", "apart"),
    ("agree", "disagree"), ("accept", "reject"), ("start", "stop"), ("begin", "end"), ("open", "close"), ("arrive", "leave"), ("stay", "go"),
    ("join", "quit"), ("win", "lose"), ("improve", "worsen"), ("like", "dislike"), ("support", "oppose"), ("friend", "enemy"),
    ("peace", "argument"), ("calm", "angry"), ("trust", "distrust"), ("planning", "cancelled"),
)
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{200D}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
#: The emoji ranges one by one, and the emoticons, of the personas.
EMOTICON_RANGES = (
    r"\x{1F600}-\x{1F63F}", r"\x{1F910}-\x{1F93F}", r"\x{1F940}-\x{1F97F}", r"\x{1F980}-\x{1F9BF}", r"\x{1F9C0}-\x{1F9FF}", r"\x{1FA70}-\x{1FA7F}", r"\x{1FA80}-\x{1FABF}", r"\x{1FAC0}-\x{1FAFF}",
)
EMOTICONS = rf"[{''.join(EMOTICON_RANGES)}]|[:;]-?[)(DPpOo/\\|]|<3|:'[(]|xD|XD|:\)|;\)|:D"
#: The cue words of each aspect of a persona question; the first aspect with a cue counts.
ASPECT_CUES = {
    "habits": ("habit", "routine", "daily", "sleep", "eat", "food", "exercise"),
    "style": ("talk", "communicate", "style", "tone", "emoji", "how do they"),
    "personality": ("personality", "trait", "character", "kind of person", "type of person", "describe"),
}

#: Own small valence table for the default sentiment scorer.
VALENCE = {
    "love": 3.2, "loved": 2.9, "great": 3.1, "good": 1.9, "happy": 2.7, "excited": 1.4, "awesome": 3.1, "amazing": 2.8, "wonderful": 2.7,
    "fantastic": 2.6, "nice": 1.8, "fun": 2.3, "enjoy": 2.2, "best": 3.2, "better": 1.9, "glad": 2.0, "thanks": 1.9, "hope": 1.9,
    "proud": 2.1, "win": 2.8, "calm": 1.3, "peace": 2.5, "trust": 2.3, "like": 1.5, "care": 2.2, "welcome": 2.0, "perfect": 2.7,
    "bad": -2.5, "sad": -2.1, "hate": -2.7, "angry": -2.3, "terrible": -2.1, "awful": -2.0, "horrible": -2.5, "worst": -3.1, "worse": -2.1,
    "sick": -2.3, "tired": -1.9, "worried": -1.2, "scared": -1.9, "stressed": -1.4, "furious": -2.7, "annoyed": -1.6, "lost": -1.3,
    "died": -2.6, "fight": -1.6, "argument": -1.5, "cancelled": -1.0, "disappointed": -1.9, "miserable": -2.2, "hurt": -2.4, "pain": -2.3,
    "cry": -2.1, "failed": -2.3, "idiot": -2.3, "pathetic": -2.7, "disgusting": -2.4, "loser": -2.4, "stupid": -2.4, "lonely": -1.5,
}
BOOSTERS = {"very": 0.293, "really": 0.293, "so": 0.293, "extremely": 0.293, "totally": 0.293, "slightly": -0.293, "somewhat": -0.293, "kinda": -0.293}


def groups_in(pattern: str) -> int:
    """0 if the pattern has no capturing group, else 1."""
    return min(1, re.compile(pattern.replace("(?U)", "")).groups)
