"""Plans that turn record outputs into RDF quads and lines of text."""
