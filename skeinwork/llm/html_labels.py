"""Labelled pages from which the extraction weights are fitted: text between [[ and ]] is main text."""

PAGES = (
    """<html><head><title>T one</title></head><body><header><a href=/>Site name</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li><li><a href=/c>Sport</a></li></ul></nav>
<div class="ad">Buy two lamps and get the third one free this week.</div><article><h1>[[The river rises]]</h1><p>[[Heavy rain fell over the hills on Monday and the river rose by two metres within a day, the office said.]]</p><p>[[Farmers moved their herds to higher ground while <a href=/r>volunteers</a> filled sand bags along the banks.]]</p>
<aside>Read also: ten facts about rivers</aside><p>[[By the evening the water had reached the lower houses of the town.]]</p></article><footer>&copy; Site name. All rights reserved.</footer></body></html>""",
    """<html><body><div id="cookie-notice">We use cookies. By staying here you accept them. <button>Accept</button></div><div class="header masthead"><h2>Daily paper</h2><form><input name=q><label>Search the site</label></form></div>
<div class="menu"><a href=1>News</a> <a href=2>Opinion</a> <a href=3>Culture</a></div><main><h1>[[A new bridge]]</h1><p>[[The council agreed on Tuesday to build a bridge across the bay, after ten years of talks about its price.]]</p><ul><li>[[It will be forty metres high.]]</li><li>[[It will carry trains and bicycles.]]</li></ul><p>[[Work begins in spring.]]</p>
<section id="comments"><h3>Comments</h3><p>I think that this bridge is a waste of our money and nobody needs it.</p><p>Great news for all who live on the other side of the bay!</p></section></main><div class="sidebar"><h3>Most read</h3><ul><li><a href=4>Storm ahead</a></li><li><a href=5>Prices fall</a></li></ul></div><div class="footer">Contact, imprint, terms of use</div></body></html>""",
    """<html><body><div class="nav"><ul><li><a href=1>Start</a></li><li><a href=2>Blog</a></li></ul></div><div class="content"><div class="post"><h2>[[How I learned to bake]]</h2><div class="share social"><a href=f>Share</a> <a href=t>Send</a></div><p>[[My first loaf was flat and grey, and my family ate it without a word.]]</p><blockquote>[[Bread forgives, said my aunt, but it never forgets.]]</blockquote><p>[[So I kept a book of every loaf, and after a year I knew what the flour wanted from me.]]</p></div>
<div class="comments"><div class="comment"><p>Thank you for this lovely story, my loaf is in the oven now.</p></div><form>Leave a reply <textarea></textarea><button>Send</button></form></div></div><div class="widget newsletter">Subscribe to our letter and never miss a post. <form><input><button>Subscribe</button></form></div></body></html>""",
    """<html><body><table><tr><td><a href=1>Index</a></td><td><a href=2>Next</a></td></tr></table><p>[[The committee met for the third time in the old school house, and all of its members were there.]]</p><p>[[It was agreed that the well should be cleaned before winter.]]</p><p>[[The treasurer read the accounts, which were found to be right.]]</p><p><a href=1>Index</a> <a href=3>Top of page</a></p></body></html>""",
    """<html><body><div role="banner">Shop and post</div><div role="navigation"><a href=1>All</a><a href=2>Some</a></div><div id="main-content"><h1>[[Seeds for dry soil]]</h1><p>[[Some seeds wait for years until the first rain, and then grow within days.]]</p><div class="advertisement">Our seeds are the best seeds, order them today.</div><p>[[Gardeners can copy that with sand and patience.]]</p><p>[[Sow them late, water them once, and leave them alone.]]</p><footer>Filed under gardens, soil</footer></div><div class="related"><p>More about gardens: how to plant a hedge in three steps</p></div></body></html>""",
)
