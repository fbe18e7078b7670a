"""quillgraph.streaming"""
