"""helixframe.functions"""
