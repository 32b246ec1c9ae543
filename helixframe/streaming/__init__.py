"""helixframe.streaming"""
