"""A labelled table for the URL filter, written by hand: hosts by family, with paths dealt to both labels.

The hosts are of the kinds that public block lists name; none is taken from the tables that are filtered.
Subdomains, top-level domains and most paths come from one list for both labels, so that the words of
the host decide and not the language or the number in a path.
"""

from __future__ import annotations

BLOCKED = {
    "gambling": """royal-casino casinoking vegas-slots slotmachine-online poker-stars-room jackpot-city luckyroulette
        blackjack-live onlinecasino24 casino-bonus-codes spin-and-win-slots bingo-cash grandcasino-games megajackpots""",
    "betting": """sportsbetting bet-now football-bets betting-odds livebet tipster-bets bets365-mirror horse-racing-bets
        bookmaker-odds bestbettingsites wager-sports bet-bonus freebet-offers""",
    "pharmacy": """buy-viagra online-pharmacy-rx cheap-meds cialis-generic pills-online discount-pills noprescription-drugs
        pharmacy-discount weightloss-pills diet-pill-store tramadol-overnight canadian-pharmacy genericpills cheapmedsrx""",
    "adult": """xxx-videos porn-tube sexcams-live hotsex adult-movies free-porn adultvideos nude-girls milf-clips escort-girls
        erotic-shop adult-chat sex-toys-store xxxpics camgirls adultfriend webcam-sex fetish-tube""",
    "dating": """hot-singles dating-tonight meet-local-singles sexy-dating flirt-now hookup-tonight russian-brides
        singles-nearby datinghookups adult-dating lonely-wives""",
    "ads": """adserver ads-network click-tracker trackingpixel doubleads popunder-ads adtrack banner-exchange ad-click
        adsyndicate pixel-tracking trk-clicks ads-delivery admetrics affiliate-tracker adservice tracker-ads""",
    "spam": """spam-links link-farm seo-backlinks spamsite bulk-mailer free-traffic-bot buy-backlinks linkfarm-directory spammer
        cheap-followers guestbook-spam article-spinner spam-blog email-spam-list buy-likes""",
    "malware": """free-keygen crack-download virus-cleaner-now fake-antivirus driver-update-free trojan-tools download-exe-free
        malware-host pc-speedup-now flash-player-update codec-install-free""",
    "phishing": """secure-login-verify account-update-paypa1 bank-verify-login appleid-confirm verify-your-account
        signin-ebay-secure wallet-unlock-verify webmail-password-reset amaz0n-refund""",
    "piracy": """torrent-movies free-movie-streams warez-download full-movies-hd-free cracked-software mp3-download-free
        nulled-scripts pirate-streams iptv-free-list serial-keys""",
    "loans": """payday-loans fast-cash-loan cheap-loans instant-loan-approval bad-credit-loans quick-payday cash-advance-now
        debt-relief-fast loan-no-credit-check""",
    "prizes": """free-iphone-winner win-a-prize claim-your-prize free-giftcards lottery-winner free-money-now get-rich-quick
        earn-money-fast survey-rewards lucky-winner-claim free-gift-offers make-money-online""",
    "fakes": """replica-watches cheap-rolex-replica fake-handbags louis-outlet-cheap buy-fake-diploma cheap-jerseys-outlet
        essay-writing-cheap discount-sunglasses-outlet fake-passports""",
    "coins": """bitcoin-doubler crypto-giveaway free-bitcoin-faucet binary-options-profit forex-robot-profit
        crypto-pump-signals double-your-btc elon-crypto-giveaway""",
}

#: Ordinary hosts by field; a name with a dot keeps its own top-level domain.
ALLOWED = {
    "reference": """wikipedia.org wiktionary.org britannica.com gutenberg.org archive.org openlibrary.org wikidata.org
        plato.stanford.edu arxiv.org doi.org jstor.org pubmed.gov worldcat.org dictionary.com merriam-webster.com""",
    "software": """python.org gitlab.com sourceforge.net stackoverflow.com debian.org kernel.org postgresql.org mozilla.org
        readthedocs.io npmjs.com pypi.org rust-lang.org hadoop-notes docs.oracle.com learn.microsoft.com codeberg.org
        linuxjournal compiler-weekly""",
    "news": """bbc.co.uk theguardian.com lemonde.fr elpais.com spiegel.de nytimes.com reuters.com apnews.com faz.net
        zeit.de lefigaro.fr elmundo.es ansa.it npr.org aljazeera.com morning-herald evening-post city-gazette
        harbour-times valley-chronicle tribune-online daily-courier""",
    "public": """europa.eu gov.uk service-public.fr bund.de usa.gov who.int un.org nasa.gov noaa.gov census.gov
        city-of-bristol hamburg.de paris.fr madrid.es parliament.uk supremecourt.gov county-records water-authority""",
    "schools": """mit.edu ox.ac.uk ethz.ch sorbonne-universite.fr uni-heidelberg.de ucm.es stanford.edu tudelft.nl
        northfield-school st-marys-college riverside-academy teachers-network open-courses evening-classes
        kindergarten-sonnenschein""",
    "trade": """ikea.com bosch.com siemens.com lego.com decathlon.fr zara.com oak-furniture garden-centre bike-workshop
        hansen-bakery miller-and-sons roofing-smith plumber-jones paper-and-ink wool-shop tea-merchants bookshop-corner
        coffee-roasters green-grocer local-hardware optician-weber""",
    "culture": """louvre.fr rijksmuseum.nl moma.org prado.es opera-house theatre-royal jazz-festival film-archive
        poetry-foundation chamber-orchestra national-gallery folk-music pottery-studio photo-club choir-society
        writers-circle crossword-corner""",
    "health": """nhs.uk mayoclinic.org charite.de redcross.org childrens-hospital dental-practice family-doctor
        physiotherapy-centre eye-clinic nursing-journal heart-foundation midwives-association allergy-advice""",
    "travel": """lonelyplanet.com bahn.de sncf-connect.com renfe.com nationalrail.co.uk alpine-huts hiking-trails
        island-ferries youth-hostels camping-lakeside railway-museum city-walks mountain-guides harbour-tours""",
    "food": """seriouseats.com chefkoch.de marmiton.org allrecipes.com sourdough-baking vegetable-kitchen grandmas-recipes
        cheese-makers wine-growers soup-of-the-day spice-route breadmaking""",
    "nature": """nationalgeographic.com rspb.org.uk nabu.de weather-station birdwatching bee-keepers river-trust
        astronomy-club botanic-garden geology-society forest-research ocean-science butterfly-count""",
    "sport": """fifa.com uefa.com olympics.com rowing-club chess-federation swimming-team cycling-union marathon-berlin
        tennis-academy cricket-ground judo-verein athletics-results sailing-school""",
    "people": """anna-schmidt-blog thomas-moreau maria-lopez-art johnsons-diary notes-from-norway the-quiet-reader
        slow-travels another-engineer weekend-knitter father-of-three thinking-aloud motherhood-diary other-stories
        heather-and-rowan hannah-writes theodore-lane anthony-shaw nathan-theory then-and-now whether-or-not""",
    "firms": """northern-steel accounting-partners legal-aid-centre law-offices-brown insurance-guide credit-union
        savings-bank-history tax-advisers architects-studio translation-bureau printing-works shipping-agents
        cold-storage-systems bearing-supplies timber-trade engineering-works trade-union housing-association""",
    "language": """erinnerungen.de enzyklopaedie-der-dinge stadtbuecherei kirchengemeinde-nord heimatverein
        bibliotheque-municipale association-des-parents histoire-de-la-ville recettes-de-saison ecole-primaire
        asociacion-de-vecinos biblioteca-publica cocina-de-la-abuela noticias-del-valle colegio-san-jose
        thessaloniki-tours atheneum hinterland-post reinhardt-orgelbau tionesta-town onondaga-county""",
}

_SUBDOMAINS = ("", "www.", "", "m.", "www.", "blog.", "", "en.", "www.", "shop.")
_DOMAINS = ("com", "net", "org", "com", "info", "de", "com", "co.uk", "org", "fr", "net", "es")
_PATHS = (
    "/", "", "/en/17", "/de/203.html", "/fr/9", "/es/1404/", "/index.html", "/about", "/2023/05/14/a-long-walk-home",
    "/en/851.html", "/de/66", "/fr/312/", "/es/48.html", "/category/page/3", "/article/99812", "/p/4471", "/de/1290/",
    "/en/3/", "/contact", "/products/item-12", "/fr/77.html", "/es/5", "/view?id=620", "/archive/2019/11", "/en/2406",
    "/news/local/new-bridge-opens", "/a/b/c.html", "/de/8", "/fr/1033", "/es/219/", "/user/profile/71", "/tag/summer",
    "/main/readme", "/en/40/", "/de/517.html", "/docs/latest/guide.html", "/fr/6/", "/es/930", "/search?q=lamp", "/blog/first-post",
)


def _dealt(families: dict[str, str], label: int, step: int) -> list[tuple[str, int, str]]:
    """Rows (url, label, family): each host with a scheme, a subdomain, a domain and a path in turn."""
    rows = []
    for family, hosts in families.items():
        for host in hosts.split():
            k = len(rows)
            domain = "" if "." in host else "." + _DOMAINS[(k * 5 + step) % len(_DOMAINS)]
            subdomain = _SUBDOMAINS[(k * 3 + step) % len(_SUBDOMAINS)]
            rows.append((f"http{'s' * (k % 2)}://{subdomain}{host}{domain}{_PATHS[(k * 7 + step) % len(_PATHS)]}", label, family))
    return rows


LABELLED = (*_dealt(BLOCKED, 1, 0), *_dealt(ALLOWED, 0, 0))
