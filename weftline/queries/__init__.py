"""weftline.queries"""
