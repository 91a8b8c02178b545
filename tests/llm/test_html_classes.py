"""Hand-labelled pieces of articles: what stands in them and what does not belong to the text."""

import pytest

from corpusforge.llm import html_extract

GONE = [
    '<div class="article-comments"><p>{}</p></div>', '<section id="reader-comments"><h3>Comments</h3><p>{}</p></section>', '<div class="post-comments">{}</div>', '<ol class="commentlist"><li>{}</li></ol>', '<div class="comment-thread"><div class="comment-body">{}</div></div>',
    '<div class="comments-section">{}</div>', '<div id="disqus_thread">{}</div>', '<div class="readerComments">{}</div>', '<div class="related-posts"><a href="/a">{}</a></div>', '<div class="related-articles">{}</div>', '<aside>{}</aside>', '<div class="recommended-stories">{}</div>',
    '<div class="promo-card">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<span class="advert-label">{}</span>', '<div class="ad-slot-2">{}</div>', '<div class="sponsored-content">{}</div>', '<div class="share-buttons">{}</div>', '<ul class="post-share"><li>{}</li></ul>', '<div class="social-icons">{}</div>',
    '<div class="article-footer">{}</div>', '<div class="blog-sidebar">{}</div>', '<div class="cookieNotice">{}</div>', '<p class="legal-notice">{}</p>', '<div class="newsletterSignup">{}</div>', '<ul class="menu"><li><a href="/">{}</a></li></ul>', '<div class="breadcrumbs"><a href="/">Home</a> / <a href="/x">{}</a></div>',
    '<p class="pagination"><a href="?2">{}</a> of 9</p>', '<form><p>{}</p></form>', '<nav>{}</nav>', '<div hidden>{}</div>', '<div class="search-box">{}</div>',
]
KEPT = [
    '<p>{}</p>', '<h2 class="notice">{}</h2>', '<h3 class="search">{}</h3>', '<h2 id="comments">{}</h2>', '<ul class="menu"><li>{}</li><li>Fish</li></ul>', '<div class="article-header"><h1>{}</h1></div>', '<div class="entry-content"><p>{}</p></div>', '<p class="lead-text">{}</p>', '<section class="share-prices">{}</section>',
    '<div class="comment-free">{}</div>', '<blockquote class="story-text">{}</blockquote>', '<p class="advertising-history">{}</p>', '<div class="navigationalAids">{}</div>', '<div class="menu"><p>{} and a <a href="/w">word</a></p></div>', '<span class="label">{}</span>', '<div class="post-body">{}</div>', '<figure><figcaption>{}</figcaption></figure>',
    '<div class="socialism">{}</div>', '<table class="list-items"><tr><td>{}</td></tr></table>', '<p class="cookies-recipe">{}</p>', '<div class="post-title">{}</div>', '<pre class="search-algorithm">{}</pre>', '<div class="headerless">{}</div>', '<p id="footer-notes-explained">{}</p>',
]


@pytest.mark.parametrize("piece", GONE)
def test_furniture_inside_articles(piece):
    page = f"<body><article><p>First words.</p>{piece.format('marked words')}<p>Last words.</p></article></body>"
    assert html_extract.judge([html_extract.blocks_of(page)]) == ["First words. Last words."]


@pytest.mark.parametrize("piece", KEPT)
def test_text_inside_articles(piece):
    page = f"<body><article><p>First words.</p>{piece.format('marked words')}<p>Last words.</p></article></body>"
    got = html_extract.judge([html_extract.blocks_of(page)])[0]
    assert got.startswith("First words. ") and "marked words" in got and got.endswith(" Last words.")


def test_all_pieces_together():
    """One article with every piece, kept and not: nothing leaks from one element into the next."""
    pieces = [x for pair in zip(GONE, KEPT + KEPT) for x in pair]
    page = "<body><article>" + "".join(p.format(f"words{i}") for i, p in enumerate(pieces)) + "</article></body>"
    got = html_extract.judge([html_extract.blocks_of(page)])[0].split()
    assert [w for w in got if w.startswith("words")] == [f"words{i}" for i in range(1, len(pieces), 2)]
