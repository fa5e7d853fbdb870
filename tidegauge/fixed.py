"""Word lists, weights and thresholds the results depend on.

Everything here is data.  Lists above a couple of hundred words (the extended
conversational stop list) are parameters of the functions that use them.
"""

# --- fixed values: token classes -------------------------------------------
URL_DEBRIS = "bit com http https ly t tinyurl url www amp co".split()

TOPIC_NOISE = (
    "additional advisory afd airnow aqi details digit discussion forecast iembot issued prelim statement update"
).split()

NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion trillion"
).split()

ORDINAL_WORDS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()

WEAK_WORDS = (
    "a about after all also am an and another any anyone anything are as at back beautiful because been before "
    "being best better both but by can cant cest come could couldnt day de did didnt do does doesnt dont else ever "
    "every everyone first for from get give go good got great had has have havent here how i ich if ill im in into "
    "is isnt it its ive just keep kind last let like link little look make many maybe me mind more morning most "
    "much must my need new next no not now of oh ok okay on once one only or our out over part people please point "
    "por post pretty que read right same say see so some someone something still such take talk that thats the "
    "their them then there these they this those through time to today tomorrow monday tuesday wednesday thursday "
    "friday saturday sunday january february march april may june july august september october november december "
    "true und us very wait was wasnt watch we well went what when where which while who why will with would "
    "wouldnt yeah yes you your"
).split()

ACRONYMS = "api btc djt eth eu fbi gop nba nfl nft nsa nyse sec spy uk un usa xrp".split()

ENTITIES = (
    "america", "bluesky", "bsky", "china", "djt", "ethereum", "google", "ice", "iran", "israel", "kalshi",
    "no kings", "nyse", "openai", "palestine", "polymarket", "republican", "republicans", "russia", "trump",
    "ukraine", "usa",
)

STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with"
).split()

TOPIC_BLOCKLIST = (
    "a an and bad bro crazy good got i like look need people really rival that thing this today want wild"
).split()

CONNECTORS = "& at for in of on the to".split()

# --- fixed values: alias rules (key, label, type, confidence, aliases) -------
ALIAS_RULES = (
    ("no kings", "No Kings", "movement", 0.99,
     ("nokings", "no king", "no kings", "no kings's", "no kingss", "no-kings", "#nokings", "#no-kings", "#no_kings")),
    ("usa", "USA", "country", 0.92,
     ("usa", "america", "american", "americans", "united states", "united-states", "unitedstates", "u s a", "u.s.a")),
    ("iran", "Iran", "country", 0.92, ("iran", "iranian", "iranians")),
    ("bluesky", "Bluesky", "platform", 0.96, ("bluesky", "bsky", "#bluesky", "#bsky")),
    ("nyse", "NYSE", "market", 0.98, ("nyse", "new york stock exchange", "new-york-stock-exchange")),
    ("polymarket", "Polymarket", "platform", 0.97, ("polymarket", "poly market", "poly-market")),
    ("kalshi", "Kalshi", "platform", 0.97, ("kalshi", "kal shi", "kal-shi")),
)

# --- fixed values: rule-tag vocabularies --------------------------------------
CRYPTO_TERMS = (
    "airdrop altcoin bitcoin blockchain coin crypto dex defi eth ethereum nft onchain sol solana token wallet web3"
).split()
MEMECOIN_TERMS = "ape degen doge memecoin moon pepe pump rug shib".split()
ECOMMERCE_TERMS = (
    "alibaba aliexpress checkout ecommerce fulfillment inventory shop shopify sku supplier wholesale"
).split()
DROPSHIP_TERMS = "dropship dropshipping drop-shipping".split()
PRODUCT_TERMS = "catalog launch listing merch product retail store trend".split()

# --- fixed values: sentiment lexicons ------------------------------------------
POSITIVE_WORDS = {
    "awesome": 2, "bullish": 2, "excellent": 2, "good": 1, "great": 2, "improve": 1, "improved": 1, "love": 3,
    "positive": 1, "strong": 1, "upside": 1, "win": 2,
}
NEGATIVE_WORDS = {
    "awful": 2, "bad": 1, "bearish": 2, "crash": 2, "dump": 2, "fail": 2, "hate": 3, "loss": 2, "negative": 1,
    "risk": 1, "scam": 2, "weak": 1,
}
NEUTRAL_WORDS = {"fine": 1, "ok": 1, "okay": 1}

# --- fixed values: topic scoring ------------------------------------------------
TYPE_BASE = {"cashtag": 0.74, "hashtag": 0.67, "entity": 0.56, "keyword": 0.40}
TYPE_FLOOR = {"cashtag": 0.34, "hashtag": 0.38, "entity": 0.45, "keyword": 0.62}
TYPE_RANK = {"cashtag": 1, "hashtag": 2, "entity": 3, "keyword": 4}
BLOCKED_KEYS = ("all", "general", "digit")
MIN_CONFIDENCE = 0.34

# --- fixed values: patterns -------------------------------------------------------
URL_PATTERN = r"(https?://[^\s<>\"]+)"
HASHTAG_PATTERN = r"(?:^|\s)#([A-Za-z0-9_]{1,100})"
HANDLE_PATTERN = r"(?:^|\s)@([A-Za-z0-9_.-]{1,100})"
CASHTAG_PATTERN = r"\$([A-Za-z][A-Za-z0-9]{1,15})"
WORD_PATTERN = r"([a-z0-9][a-z0-9_'-]{1,63})"
TOPIC_TOKEN_PATTERN = r"([a-z0-9$#]+)"
PHRASE_TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9&'-]*"
BOT_PATTERN = r"(^| )([a-z0-9]+bot)( |$)"
LINK_WORD_PATTERN = r"(^| )(https?|www|com|co|t|ly|amp)( |$)"
WEATHER_PATTERN = r"(area|forecast|discussion).*(afd|airnow|aqi)"
DETAIL_PATTERN = r"(additional|details) here"

# --- fixed values: narrative label vocabularies -----------------------------------
NARRATIVE_STOP_WORDS = (
    "the and for with this that from into your their about after before there where which what when while just more "
    "some over under than then they them have will would could should news reddit thread post today yesterday people "
    "because through still being new best good like show shows says said most very here look gets getting take takes "
    "using used first across discussion discussing company companies update updates breaking latest reaction reactions "
    "general internet online community communities communitys question questions thought thoughts opinion opinions "
    "story stories video videos photo photos image images article articles comment comments threads companys thing "
    "things anyone everyone something anything many much around another others going went come comes came made make "
    "makes may might also really maybe seems seem down via"
).split()
NARRATIVE_WEAK_WORDS = (
    "access advice against any are back been begin begins behind being but build building can change coming day daily "
    "das don did do does done dozen dozens dont even eles ever else explain explainer every everything full game get "
    "guys hey going hard happening has help her hello hi how his ive know last let move need needs note now not "
    "objective official one only once own part por play please product read right rolling seek seeks set sets should "
    "somebody someone sao share thank thanks taking there these theyre teaser though three think those time today "
    "tomorrow track tool tools trailer trying try uncover urge user watching want welcome were whats who why wrong "
    "year you away again auf bom dia important"
).split()
NARRATIVE_WEAK_PHRASES = (
    "are not", "are you", "been building", "can explain", "can you explain", "casual off topic", "everything coming",
    "daily welcome", "don get", "don know", "did you", "done all", "early access", "even though", "estado unido",
    "every day", "finished watching", "full time", "has else", "his own", "last year", "long term", "middle east",
    "need advice", "need help", "now but", "off topic", "play game", "official teaser", "official teaser trailer",
    "official trailer", "only one", "part three", "real time", "read share", "right now", "shut down", "trying get",
    "thank you", "those who", "united state", "user uncover who", "was hard", "what is going on", "what going on",
    "you can", "you ever", "you guy", "you guys", "you think",
)
NARRATIVE_ACRONYMS = "ai api gpu cpu wsb usa uk eu btc eth".split()
NARRATIVE_DISPLAY = {
    "airpods": "AirPods", "ai": "AI", "api": "API", "btc": "BTC", "cpu": "CPU", "dlc": "DLC", "dlss": "DLSS",
    "eth": "ETH", "eu": "EU", "gpu": "GPU", "gta": "GTA", "jit": "JIT", "nato": "NATO", "pokemon": "Pokemon",
    "uk": "UK", "usa": "USA", "wsb": "WSB",
}
NARRATIVE_TOKEN_ALIASES = {
    "agents": "agent", "airpod": "airpods", "models": "model", "chips": "chip", "tariffs": "tariff",
    "elections": "election", "memes": "meme", "memecoins": "memecoin", "tokens": "token", "videos": "video",
    "politics": "politic", "markets": "market", "companies": "company", "conflicts": "conflict", "wars": "war",
    "trumps": "trump", "irans": "iran", "israels": "israel", "chats": "chat", "llms": "llm", "usa": "us",
    "america": "us",
}
PLATFORM_LABEL_WORDS = (
    "account accounts app bsky channel channels com comment comments did feed feeds follow follows following ingest "
    "interaction interactions live network plc post posts profile profiles reddit reply replies repost reposts social "
    "stream telegram thread threads user users video videos watch www youtube bluesky"
).split()
PLATFORM_LABEL_PHRASES = (
    "app bsky profile", "bsky social", "bluesky live ingest", "bluesky post", "bluesky posts", "bluesky social",
    "com www youtube", "social live",
)
TEMPORAL_LABEL_WORDS = (
    "aedt aest jan january feb february mar march apr april may jun june jul july aug august sep sept september oct "
    "october nov november dec december monday mst tuesday pdt pst wednesday thursday friday saturday sunday utc gmt "
    "est edt cst cdt cet cest ist jst kst"
).split()
FRAGMENT_LEADS = "dear done even hard hey help her his hi need needs official only own though was were".split()
FRAGMENT_TAILS = "advice again all done hard help here one own teaser there though today tomorrow trailer".split()
FRAGMENT_LABEL_PATTERNS = (
    r"^(dear|hey|hi)\s+[a-z0-9]+(\s+[a-z0-9]+)?$", r"^(need|needs)\s+(help|advice)\b", r"^(even though)\b",
    r"^(his|her|their|our|my)\s+own\b", r"^(done all)\b", r"^(early access)$",
    r"^(official\s+(teaser|trailer))(\s+(trailer|video))?$", r"^(only one)$", r"^(the only one)$",
    r"^(was|were)\s+hard\b",
)
QUESTION_LABEL_PATTERN = r"^(how|why|what|when|where|who|can|should|would|could)\b"
URL_LABEL_WORDS = "app bsky com gg http https net org profile status tv watch www".split()
QUESTION_OPENERS = (
    r"(?i)^(what|why|how|when|where|who|are|is|can|could|would|should|do|does|did|have|has|will|anyone|someone|"
    r"does anyone|can anyone)\b"
)
GENERIC_THREAD_PATTERN = (
    r"(?i)(\bdaily discussion\b|\bdiscussion thread\b|\bmegathread\b|\bopen thread\b|\boff[ -]?topic\b|"
    r"\bcasual conversation\b|\bpromote your business\b|\bwhat are your moves tomorrow\b|\bwhat are you working on\b)"
)
MEME_KEYWORDS = "meme memecoin token coin crypto shitpost viral dank doge solana pepe wallstreetbets wsb".split()
URL_DROP_KEYS = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid si ref ref_src".split()
URL_INTERNAL_HOSTS = "bsky.app staging.bsky.app bsky.social".split()

# --- fixed values: cluster label vocabularies ------------------------------------------
LABEL_STOP_WORDS = "a an and are as at by for from in into is of on or the to with".split()
LABEL_GENERIC_WORDS = (
    "affairs alerts analysis article articles brief briefing briefings cluster clusters commentary content context "
    "conversation conversations coverage current daily debate debates detail details discussion discussions file files "
    "identification issue issues mixed narrative narratives news policy post posts public references related reports "
    "roundup scanner series signal signals story stories summary thread threads update updates"
).split()
LABEL_TEMPORAL_WORDS = (
    "apr april aug august day dec december feb february friday jan january jul july jun june mar march may monday "
    "month nov november oct october saturday sep sept september sunday thursday today tomorrow tuesday wednesday "
    "yesterday"
).split()
LABEL_FRAGMENT_PATTERNS = (
    r"^(dear|hey|hi)\s+[a-z0-9]+(\s+[a-z0-9]+)?$", r"^(need|needs)\s+(help|advice)\b",
    r"^(official\s+(teaser|trailer))(\s+(trailer|video))?$", r"^(only one)$", r"^(published on)\b",
    r"^([a-z]?h?mouds|epublicans|itchen|niverse|onate|alaxy)$",
)
LABEL_GENERIC_PATTERNS = (
    r"^(march|april|monday|tuesday|wednesday|thursday|friday|saturday|sunday)$",
    r"^(current affairs|mixed discussion cluster|public safety updates)$",
)

# --- fixed values: stored-name rules -------------------------------------------------------
NAME_GENERIC_PHRASES = (
    "broad discussion", "general conversation", "general discussion", "generic discussion", "mixed discussion",
    "mixed discussion cluster", "online conversation", "recent posts", "social discussion", "social media discussion",
    "trend discussion",
)
NAME_GENERIC_WORDS = (
    "about broad cluster content conversation discussion event general mixed miscellaneous narrative online posts "
    "recent social topic trend update updates"
).split()
NAME_NARRATIVE_WORDS = (
    "appeals backlash campaign controversy debate discourse escalation fallout fight fundraising movie policy "
    "reactions response responses rhetoric rumor rumors speculation trial vote"
).split()
NAME_FRAGMENT_PATTERN = r"(apital|eneral|etting|hased|arket|tion|ment|ally|ized)$"
NAME_SHORT_OK = "ai uk us eu".split()

# --- fixed values: title rules -----------------------------------------------------------------
TITLE_GENERIC_WORDS = (
    "attention analysis board breaking coverage debate debates dashboard discussion discourse headline headlines "
    "internet latest media narrative narratives news online speculation story stories today topic topics trend trends "
    "update updates viral"
).split()
TITLE_PUNCTUATION = r"[:;?!]|\.{2,}|…|[\"“”]"
TITLE_HEADLINE_WORDS = r"(?i)\b(analysts|because|breaking|explainer|how|latest|report|reports|says|watch|why)\b"

# --- fixed values: board overlap vocabularies ----------------------------------------------------
BOARD_GENERIC_WORDS = (
    "analysis board coverage debate discussion headline internet latest media moment narrative news story topic trend "
    "update viral wave"
).split()
BOARD_WEAK_WORDS = "chaos crew duo energy era frenzy hype mania momentum saga storm vibes".split()


# --- fixed values: attention profile of a text (phrases by bucket, weights, categories) ----------------------
PROFILE_PREFERRED = {
    "animal_meme": "animal, cat, cats, dog, dogs, doge, frog, frogs, hippo, penguin, mascot, character, creature, pom, pomeranian, shiba, pepe, mog, wojak",
    "catchphrase_wave": "catchphrase, slogan, nickname, tagline, quote, one-liner, copypasta, chant, soundbite",
    "creator_viral_moment": "creator, creators, influencer, influencers, streamer, streamers, youtuber, tiktoker, vtuber, fanbase, podcast, livestream, channel, clip farm",
    "celebrity_meme": "celebrity, actor, actress, musician, rapper, singer, athlete, superstar, swiftie, stan",
    "platform_drama": "twitter, x.com, reddit, subreddit, tiktok, youtube, telegram, discord, twitch, verification, algorithm, moderation, outage, platform backlash, platform debate",
    "ai_meme_wave": "ai companion, ai girlfriend, ai boyfriend, deepfake, parody edit, image model, video model, ai agent, agents, grok, chatgpt, claude, gemini, avatar, companion",
    "fandom_wave": "anime, manga, fan edit, fan edits, fancam, fan art, fandom, shipping, stan war, k-pop, cosplay, pokemon, nintendo, roblox, fortnite",
    "gaming_meme": "gaming, game, gamer, steam, patch notes, speedrun, boss fight, lootbox, nerf, buff",
    "crypto_spillover": "memecoin, memecoins, meme coin, solana meme, base meme, launchpad, pump.fun, letsbonk, cto, community takeover, etf inflows, spot bitcoin etf, "
                        "token launch, listing, retail speculation, onchain speculation, rotation",
    "meme_distribution": "viral, meme, memes, remix, remixes, parody, parodies, edit, edits, clip, clips, shitpost, shitposts, reaction image, reaction images, reposts, "
                         "timeline, brainrot, quote tweet",
    "tokenizable_object": "mascot, character, companion, avatar, nickname, catchphrase, slogan, clip, deepfake, parody, frog, dog, cat, hippo",
    "memeified_politics": "mugshot, debate clip, rally clip, slogan meme, campaign meme, parody ad, quote tweet war",
}
PROFILE_DEPRIORITISED = {
    "geopolitics_macro": "ceasefire, tariff, tariffs, inflation, interest rates, rate cut, rate hike, federal reserve, senate, parliament, sanction, sanctions, missile, missiles, war, wars",
    "dry_business": "enterprise, enterprises, earnings, board meeting, procurement, partnership framework, pricing update, api pricing, internal rollout, b2b, quarterly",
    "dry_crypto": "committee hearing, compliance, governance, validator update, consensus upgrade, infrastructure release, audit, framework, interoperability",
    "hard_news": "attack, attacks, earthquake, wildfire, evacuation, fatalities, police, court filing, indictment",
    "generic_noise": "internet debate, creator drama, celebrity drama, platform update, policy development, market update, trend update, news update",
}
PROFILE_WEIGHTS = {
    "animal_meme": 8.0, "catchphrase_wave": 7.0, "creator_viral_moment": 6.0, "celebrity_meme": 5.0, "platform_drama": 6.0, "ai_meme_wave": 7.0, "fandom_wave": 6.0,
    "gaming_meme": 6.0, "crypto_spillover": 7.0, "meme_distribution": 6.0, "tokenizable_object": 6.0,
    "dry_business": -10.0, "dry_crypto": -8.0, "hard_news": -12.0, "generic_noise": -8.0,
}
PROFILE_TOKENIZABLE = "animal_meme catchphrase_wave creator_viral_moment ai_meme_wave fandom_wave gaming_meme crypto_spillover tokenizable_object".split()
PROFILE_BUCKETS = {
    "ai tech": "ai_tech", "animal meme": "meme", "catchphrase wave": "meme", "creator viral moment": "creator", "creator": "creator", "culture": "internet_culture",
    "celebrity meme": "entertainment", "entertainment": "entertainment", "platform drama": "internet_culture", "ai meme wave": "ai_tech", "fandom wave": "entertainment",
    "gaming": "gaming", "gaming meme": "gaming", "meme": "meme", "crypto spillover": "crypto_spillover", "crypto": "crypto_spillover",
    "memeified politics": "memeified_politics", "internet culture": "internet_culture",
}
PROFILE_WORD_PATTERN = r"[a-z0-9$#][a-z0-9$#'_-]{1,63}"


# --- fixed values: how well an asset fits the board's themes ---------------------------------------------------
ASSET_CULTURE_TERMS = {
    "meme": "meme, memes, shitpost, shitposting, viral, virality, frog, doge, dog, cat, animal, mascot, catchphrase, nickname, slogan, pepe, reaction image, joke, parody, brainrot",
    "internet_culture": "internet, online, timeline, twitter, x.com, tiktok, twitch, discord, reddit, bluesky, copypasta, stream, deepfake, remix, repost, fan edit, platform backlash, trend",
    "entertainment": "movie, film, music, album, artist, celebrity, fandom, stan, show, series, anime, manga, tv, box office",
    "gaming": "gaming, game, gamer, esports, xbox, playstation, switch, steam, minecraft, fortnite, roblox, league, nintendo",
    "creator": "creator, influencer, streamer, youtube, youtuber, podcast, vtuber, tiktok, channel, fanbase, community, onlyfans, clip, livestream",
    "ai_tech": "ai, artificial intelligence, agent, agents, openai, gpt, claude, llm, robot, model, tech, gpu, chip, automation, deepfake, companion, grok, avatar",
    "crypto_spillover": "memecoin, memecoins, meme coin, solana meme, base meme, launchpad, pump.fun, letsbonk, cto, community takeover, etf inflows, spot bitcoin etf, token launch, "
                        "listing, retail speculation, rotation",
    "memeified_politics": "mugshot, debate clip, rally clip, campaign meme, parody ad, quote tweet war",
}
ASSET_STYLE_TERMS = ("meme, memecoin, meme coin, cto, community takeover, cult, degen, viral, shitpost, shitcoin, dog, doge, cat, frog, pepe, bonk, wif, fart, mog, chad, giga, "
                     "anime, waifu")
ASSET_UTILITY_TERMS = ("protocol, infrastructure, bridge, staking, restaking, validator, node, wallet, oracle, governance, lending, borrow, yield, stablecoin, payments, payment, "
                       "settlement, perpetual, perps, derivatives, launchpad, layer1, layer2, rollup, mainnet, testnet, router, swap, dex, exchange, liquid staking, cross-chain, "
                       "crosschain, consensus, data availability, rwa, real world asset")
ASSET_SOCIAL_TERMS = "telegram, discord, twitter, x.com, tiktok, youtube, twitch"
ASSET_SOURCE_BONUS = {"dex_community_takeovers_latest": 14.0, "dex_boosts_top": 10.0, "dex_boosts_latest": 6.0, "dex_profiles_latest": 4.0}

# -- board rows: words that make a single word a story, and summaries that say nothing --
STORY_WORDS = ["appeals", "backlash", "campaign", "controversy", "criticism", "debate", "discourse", "escalation", "fallout", "holiday", "mentions", "mission", "policy",
               "reactions", "rhetoric", "speculation", "trial"]
EMPTY_SUMMARY_PATTERNS = [r"discussion trend detected from recent social posts\.?$", r"topic key appears malformed\.?$", r"too few unique authors support the cluster\.?$"]
